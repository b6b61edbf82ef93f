"""WARC archives and chat formatting: exact round trips, pushed predicates, edge cases."""

import base64
import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm import chat, warc
from siltworks.plans.scratch import scratch_path

PAGES = "page_id long, url string, html string, payload string"
ROWS = [
    (1, "http://a/1", "<p>é</p>", "x"), (2, "http://a/2\r\nX: y", "<p>é</p>", None), (3, None, None, None), (4, "http://a/4", "", ""),
    (5, "http://a/5", "WARC/1.1\r\n\r\n\r\n" * 3, ""), (6, "http://a/6", "z" * 300_000, ""), (6, "http://a/6", "z" * 300_000, ""),
    (None, "http://a/n", "<p>é</p>", ""), (None, None, "only", ""),
]


def sha1_32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def write(spark, rows, **options):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(warc.records(spark.createDataFrame(rows, PAGES), "page_id", "html", "url", **options), path)
    return path


def test_archive_round_trip(spark):
    back = warc.read_archive(spark, write(spark, ROWS), verify=True).collect()
    assert len(back) == len(ROWS)
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload).decode()) for r in back)
    first = {}
    for i, _, html, _ in ROWS:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html, _ in ROWS:
        html = html or ""
        of = first.get(html)
        revisit = of is not None and of != i
        want.append((f"urn:page:{'none' if i is None else i}", "revisit" if revisit else "response", f"urn:page:{of}" if revisit else None, len(html.encode()), sha1_32(html), None if revisit else html))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or ""))


def test_small_payloads_are_never_revisits(spark):
    back = warc.read_archive(spark, write(spark, ROWS, revisit_bytes=100)).collect()
    assert {r.record_id for r in back if r.record_type == "revisit"} == set()


def test_predicates_reach_the_reader(spark):
    path = write(spark, ROWS)
    df = warc.read_archive(spark, path, payloads=False).where("record_type = 'revisit' and target_uri = 'http://a/n'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("BatchScan")[0].replace("record_type#", "", 1) or "PushedFilters" in plan or "Filter" not in plan
    assert [r.refers_to for r in df.collect()] == ["urn:page:1"]
    reader = warc.WarcReader({"path": path, "payloads": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    later = GreaterThan(("payload_bytes",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), later])) == [later]
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert rows and all(r["record_type"] == "revisit" and r["payload"] is None for r in rows)


def test_uncompressed_archives_and_uncommitted_files(spark, tmp_path):
    one = {"record_id": "urn:x:1", "record_type": "response", "refers_to": None, "target_uri": "u", "date": "d", "content_type": None, "payload_digest": sha1_32("abc"), "payload": b"abc"}
    (tmp_path / "a.warc").write_bytes(warc.record_bytes(one) + warc.record_bytes(one | {"record_id": "urn:x:2"}))
    back = warc.read_archive(spark, str(tmp_path), verify=True).orderBy("record_id").collect()
    assert [(r.record_id, bytes(r.payload)) for r in back] == [("urn:x:1", b"abc"), ("urn:x:2", b"abc")]
    path = write(spark, ROWS[:2])
    from urllib.parse import urlparse

    with open(f"{urlparse(path).path}/left-over.warc", "wb") as f:  # of an attempt that was lost
        f.write(b"rubbish")
    assert warc.read_archive(spark, path).count() == 2


def test_empty_archive(spark):
    assert warc.read_archive(spark, write(spark, [])).count() == 0


@given(st.text(alphabet="<|\\aé😀 >", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(s):
    assert chat.unescape(chat.escape(s)) == s
    assert not any(m in chat.escape(s) for m in (chat.ROLE, chat.TEXT, chat.END)) and "<|" not in chat.escape(s)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|end|>"]), st.text(max_size=30).filter(lambda t: t.isprintable())), max_size=5))
@settings(max_examples=100, deadline=None)
def test_mask_covers_assistant_texts_alone(turns):
    t = TOKENIZER
    text, spans = chat.render(turns)
    offsets = np.asarray(t.encode(text, add_special_tokens=False).offsets, dtype=np.int32).reshape(-1, 2)
    mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
    assert chat.masked_text(text, offsets[:, 0], offsets[:, 1], mask) == "".join(x for r, x in turns if r == "assistant")
    assert chat.parse(text) == turns


TOKENIZER = chat.tokenizer(chat.public_tokenizers.path("byte_bpe_50k.json"))


def test_conversations_with_gaps(spark):
    rows = [
        (1, 2, "assistant", "b<|end|>\\|"), (1, 1, "user", "a"), (1, None, "system", None), (2, 1, None, None), (None, 1, "assistant", "x" * 50_000), (1, 2, "assistant", "b<|end|>\\|"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 * len("b<|end|>\\|")
    assert got[1].turns_sha256 == hashlib.sha256(b"system\n\nuser\na\n" + b"assistant\nb<|end|>\\|\n" * 2).hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[None].loss_chars == 50_000
    assert chat.format_conversations(df.limit(0)).count() == 0
