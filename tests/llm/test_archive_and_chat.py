import hashlib
import re

import pytest
from pyspark.sql import functions as F

from boreline.llm.perspectives import rotate
from boreline.llm.shared import new_path
from boreline.llm.warc_store import export_warc, read_records, write_archive

PAGES = "page_id long, url string, html string, record string, payload string"


def archived(spark, rows):
    path = new_path(spark, "warc-test")
    write_archive(spark.createDataFrame(rows, PAGES), path)
    return path, read_records(spark, path)


def test_records_come_back(spark):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "http://a/\r\nX: y", big), (5, "http://b", big), (5, "http://b", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "u", None),
            (7, "u", ""), (None, "u", big), (8, "u", "z" * 200000), (None, None, None)]
    path, got = archived(spark, [(*r, "other", "other") for r in rows])
    out = sorted(((r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in got.collect()), key=str)
    want = sorted(((i, h or "", "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else None) for i, _, h in rows), key=str)
    assert out == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    for r in got.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
        assert hashlib.sha1(bytes(r.payload)).hexdigest().encode() in head
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        assert body == (bytes(r.payload) if r.record_type == "response" else b"")


def test_archive_as_files(spark):
    path, got = archived(spark, [(1, "u", "a\r\n\r\nb", "", ""), (2, "v", "c", "", "")])
    export_warc(got, f"{path}/files")
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/files/part-*").collect())
    found = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        found.append(rest[:n].partition(b"\r\n\r\n")[2])
        assert rest[n: n + 4] == b"\r\n\r\n"
        data = rest[n + 4:]
    assert sorted(found) == [b"a\r\n\r\nb", b"c"]


def test_a_changed_payload_is_found(spark):
    path, _ = archived(spark, [(1, "u", "right", "", "")])
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"wrong")).collect()
    spark.createDataFrame(bad, "content binary, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        read_records(spark, path).select("payload").collect()


def test_no_pages(spark):
    _, got = archived(spark, [])
    assert got.count() == 0


TURNS = "conv_id long, turn long, role string, text string, speaker string, part string"


def plain_views(rows, size, fixed=("system",)):
    out = set()
    first = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    for conv in {r[0] for r in rows}:
        turns = [r for r in rows if r[0] == conv]
        for who in {r[2] for r in turns} - {None, *fixed}:
            parts = {}
            for r in turns:
                parts.setdefault(-1 if r[1] is None else r[1] // size, []).append(r)
            for p, own in parts.items():
                own.sort(key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), r[3] or ""))
                for s in range(0, len(own), size):
                    text, spans = "", []
                    for r in own[s: s + size]:
                        tag = r[2] if r[2] in fixed else "assistant" if r[2] == who else f"user name={r[2] or 'unknown'}"
                        text += f"<|im_start|>{tag}\n"
                        a = len(text)
                        text += (r[3] or "") + "<|im_end|>\n"
                        if r[2] == who:
                            spans.append((a, len(text) - 1))
                    out.add((conv, who, p, s // size, min(size, len(own) - s), text, ",".join(f"{a}-{b}" for a, b in spans), sum(b - a for a, b in spans)))
    return out


@pytest.mark.parametrize("size", [3, 256])
def test_every_speaker_has_a_view(spark, size):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé \U0001F600"), (1, 2, "bob", "hi"), (1, 3, None, "who?"), (1, 4, "ann", None), (1, 5, "bob", ""),
            (2, 0, "system", "only"), (3, None, "ann", "x"), (3, 7, "ann", "long " * 5000), (None, 1, "cy", "no conversation"), (None, 1, "cy", "again"),
            (4, 1, "dan", "same"), (4, 1, "dan", "same"), (4, 1, "dan", "same"), (4, 1, "eve", "tie"), (4, 1, "dan", "same")]
    rows += [(5, t, ["ann", "bob", "cy"][t % 3], f"turn {t}") for t in range(700)]
    got = rotate(spark.createDataFrame([(*r, "other", "other") for r in rows], TURNS), size)
    assert got.columns == ["conv_id", "speaker", "part", "slice", "n_turns", "text", "mask", "n_mask_chars"]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == plain_views(rows, size) and len(set(found)) == len(found)


def test_no_turns(spark):
    assert rotate(spark.createDataFrame([], TURNS)).count() == 0
