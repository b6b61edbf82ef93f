"""Secret scans in DataFrame functions: fixed patterns, and a battery of randomness tests for what they miss.

Candidates are runs of 16 or more characters of encoded data whose encoding can be told (hex, base32, base36, base64), and
the parts of such runs between - and _, as in a key with a prefix; a part inside a found token is not listed again.
The null hypothesis of each test is structure: a token that is made of words, numbers or repetitions.

* alphabet uniformity: the chi-squared sum, as its count of equal pairs, against what structured text has;
* runs: changes between letters of either case, digits and signs, against the few changes of structured text;
* serial correlation: neighbours' codes, against the positive correlation of structured text.

A token counts as random only if all three reject structure (intersection-union: its p-value is the largest of the
three).  False discoveries are controlled within strata of length, because a short token can prove little: the
Benjamini-Hochberg bound is taken on a grid of z-values per stratum, rounded against discovery, over all tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import row_back, stored, text_of, whole_row

# Fixed: the base kinds, their patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
# The same spans, found faster: shorter runs need not be listed to be dropped.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
PART = r"[A-Za-z0-9+/]{16,}={0,2}"
# alphabet: (letters, share of equal pairs in structured text, share of class changes in structured text)
ENCODINGS = {"hex": (16, 0.10, 0.25), "base32": (32, 0.06, 0.12), "base36": (36, 0.06, 0.18), "base64": (64, 0.06, 0.30)}
STRUCTURED_CORRELATION = 0.6
STRATA = (24, 32, 48, 96)  # lengths at which a new stratum begins
GRID = 50  # steps per unit of z


def _spans(text: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, token>> of a pattern's matches, in code points; `group`'s length decides."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split(text, pattern, -1)
    start = lambda acc, e: acc["at"] + F.length(e["gap"])
    walk = lambda acc, e: F.struct(
        (start(acc, e) + F.length(e["m"])).alias("at"),
        F.when(
            F.length(e["v"]) >= least,
            F.concat(acc["out"], F.array(F.struct(start(acc, e).alias("start"), (start(acc, e) + F.length(e["m"])).alias("end"), e["m"].alias("token")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    kind = "array<struct<start:int,end:int,token:string>>"
    zipped = F.transform(whole, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m.alias("m"), F.get(value, i).alias("v")))
    return F.when(
        F.col(text).rlike(pattern),
        F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), walk)["out"],
    ).otherwise(F.array().cast(kind))


def _encoding(token: Column) -> Column:
    digit, lower, upper = (token.rlike(p) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (
        F.when(~digit | ~(lower | upper), None)  # words, numbers
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").when(lower & upper, "base64")
    )


def _tested(tokens: Column) -> Column:
    """The candidates whose encoding can be told, with z: how far the least convincing test is from structure."""
    kind_of = lambda c: F.when(c.between(48, 57), 1).when(c.between(65, 90), 2).when(c.between(97, 122), 3).otherwise(4)
    coded = F.filter(F.transform(tokens, lambda t: F.struct(t["start"], t["end"], t["token"], _encoding(t["token"]).alias("encoding"))), lambda t: t["encoding"].isNotNull())
    codes = F.transform(coded, lambda t: F.struct(
        t["start"], t["end"], t["encoding"], F.transform(F.split(F.regexp_replace(t["token"], "=+$", ""), ""), lambda c: F.ascii(c)).alias("codes")
    ))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("sum", "squares", "products", "changes")], F.lit(-1).alias("last"))
    follow = lambda a, c: F.struct(
        (a["sum"] + c).alias("sum"), (a["squares"] + c * c).alias("squares"),
        (a["products"] + F.when(a["last"] >= 0, a["last"] * c).otherwise(0)).alias("products"),
        (a["changes"] + F.when((a["last"] >= 0) & (kind_of(a["last"]) != kind_of(c)), 1).otherwise(0)).alias("changes"),
        c.alias("last"),
    )
    # equal pairs: in sorted order each code adds the number of equal codes before it
    alike = lambda a, c: F.struct(
        (a["pairs"] + F.when(a["last"] == c, a["run"]).otherwise(0)).alias("pairs"), F.when(a["last"] == c, a["run"] + 1).otherwise(1.0).alias("run"), c.alias("last")
    )
    pairs0 = F.struct(F.lit(0.0).alias("pairs"), F.lit(0.0).alias("run"), F.lit(-1).alias("last"))
    sums = F.transform(codes, lambda t: F.struct(
        t["start"], t["end"], t["encoding"], F.size(t["codes"]).cast("double").alias("n"), F.aggregate(t["codes"], zero, follow).alias("s"),
        F.aggregate(F.sort_array(t["codes"]), pairs0, alike)["pairs"].alias("pairs"), F.get(t["codes"], F.lit(0)).cast("double").alias("first"),
    ))
    at = lambda t, k: F.element_at(F.create_map(*[F.lit(x) for e, v in ENCODINGS.items() for x in (e, v[k])]), t["encoding"])
    stats = F.transform(sums, lambda t: F.struct(
        t["start"], t["end"], t["encoding"], t["n"], t["pairs"], t["s"]["changes"].alias("changes"), at(t, 1).alias("kappa"), at(t, 2).alias("tau"),
        (t["s"]["squares"] - t["s"]["sum"] * t["s"]["sum"] / t["n"]).alias("spread"),
        (t["s"]["products"] - (t["s"]["sum"] / t["n"]) * (2 * t["s"]["sum"] - t["first"] - t["s"]["last"]) + (t["n"] - 1) * F.pow(t["s"]["sum"] / t["n"], 2)).alias("lag"),
    ))
    expected = lambda t: t["n"] * (t["n"] - 1) / 2 * t["kappa"]
    r = lambda t: F.least(F.greatest(t["lag"] / F.greatest(t["spread"], F.lit(1e-9)), F.lit(-0.99)), F.lit(0.99))
    z1 = lambda t: (t["pairs"] + 0.5 - expected(t)) / F.sqrt(expected(t))
    z2 = lambda t: -(t["changes"] - 0.5 - (t["n"] - 1) * t["tau"]) / F.sqrt((t["n"] - 1) * t["tau"] * (1 - t["tau"]))
    z3 = lambda t: (F.atanh(r(t)) - math.atanh(STRUCTURED_CORRELATION)) * F.sqrt(t["n"] - 3)
    return F.transform(stats, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"),
        F.aggregate(F.array(*[F.lit(x) for x in STRATA]), F.lit(0), lambda a, x: a + F.when(t["n"] >= x, 1).otherwise(0)).alias("stratum"),
        F.ceil(F.greatest(F.greatest(z1(t), z2(t), z3(t)), F.lit(-38.0)) * GRID).cast("int").alias("step"),
    ))


def _bounds(cells, rate: float) -> dict[int, int]:
    """The last grid step discovered per stratum, by the step-up rule at the given rate; cells: (stratum, step, count)."""
    bounds: dict[int, int] = {}
    for stratum in {c[0] for c in cells}:
        steps = sorted((step, n) for s, step, n in cells if s == stratum)
        total, found = sum(n for _, n in steps), 0
        for step, n in steps:
            found += n
            if 0.5 * math.erfc(-step / GRID / math.sqrt(2)) <= rate * found / total:
                bounds[stratum] = step
    return bounds


def scan(docs: DataFrame, text: str = "text", rate: float = 0.01) -> DataFrame:
    """`docs` with `secrets`: array<struct<start, rank, kind, end>> sorted by start, then kind.

    Offsets count code points, the end is exclusive.  Kinds are those of `BASE` and `random`, the tokens that the
    battery finds at the false-discovery rate `rate` and no base span covers exactly.  A null or empty text has no spans.
    A column named secrets is replaced.
    The texts are read once; the stored table then has spans and candidates, and at most (strata x steps) counts of z
    reach the driver.
    """
    found = docs.select(whole_row(docs), text_of(text).alias("_text")).withColumns(
        {f"_{kind}": _spans("_text", FAST.get(kind, pattern), group, least) for kind, pattern, group, least in BASE}
        | {"_candidates": F.array_union(_spans("_text", CANDIDATE, 0, 16), _spans("_text", PART, 0, 16))}
    )
    base = F.concat(*[_ranked(f"_{kind}", kind, i) for i, (kind, *_) in enumerate(BASE)])
    found = found.select("_doc", base.alias("_base"), _tested(F.col("_candidates")).alias("_tested"))
    found = stored(found, "secrets")
    cells = found.select(F.explode("_tested").alias("t")).groupBy("t.stratum", "t.step").count().collect()
    bounds = _bounds([tuple(c) for c in cells], rate)
    is_random = lambda t: F.lit(False)
    for stratum, step in sorted(bounds.items()):
        is_random = (lambda rest, s, b: lambda t: rest(t) | ((t["stratum"] == s) & (t["step"] <= b)))(is_random, stratum, step)
    found = found.withColumn("_random", F.filter("_tested", is_random))
    inside = lambda t, w: (w["start"] <= t["start"]) & (t["end"] <= w["end"]) & ((w["start"] < t["start"]) | (t["end"] < w["end"]))
    fresh = F.filter("_random", lambda t: ~F.exists("_random", lambda w: inside(t, w)) & ~F.exists("_base", lambda b: (b["start"] == t["start"]) & (b["end"] == t["end"])))
    added = F.transform(fresh, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"), t["end"].alias("end")))
    return found.select(*row_back(docs, ("secrets",)), F.sort_array(F.concat("_base", added)).alias("secrets"))


def _ranked(column: str, kind: str, rank: int) -> Column:
    return F.transform(column, lambda t: F.struct(t["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), t["end"].alias("end")))


def listing(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; overlapping spans share one mark.  A null text stays null."""
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
    )
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))
