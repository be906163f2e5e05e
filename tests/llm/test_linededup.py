"""Line dedup against a plain dictionary version."""

import hashlib
import random
import zlib

import numpy as np

from riskweave.llm import linededup

STRIP = " \t\n\x0b\x0c\r"


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))
    holder = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                holder.setdefault(k, i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in holder or holder[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(1)
    pool = ["A shared line that repeats", "a SHARED line that repeats ", "short", "", "  ", "ÄÖÜ éèê ñññ",
            "äöü éèê ñññ", "exactly10!", "nine char", "\x0btabbed and trimmed\x0c", "x" * 5000]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < .6 else f"own line {i} {k} words"
                          for k in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n"), (3, "A shared line that repeats\nother row, same id"),
             (3, rows[3][1]), (None, "A shared line that repeats\nonly the null id has this"),
             (None, "only the null id has this"), (900, "a very common line\n" * 3000 + "end of the document")]
    rows += [(1000 + i, "a very common line of many documents") for i in range(300)]
    return rows


def test_against_dictionary(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r) for r in linededup.line_dedup_report(df).collect()), key=str)
    assert got == brute(rows)


def test_hash_over_many_partitions(spark):
    """One line in almost every document: its rows span many range partitions."""
    rows = [(i, "the same long line everywhere\nown line number %d here" % i) for i in range(2000)]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["n_dropped"] for r in linededup.line_dedup_report(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert got == {i: int(i > 0) for i in range(2000)}


def test_extra_columns_and_texts(spark):
    rows = [(1, "line one is long\nkeep", "a"), (2, "line one is long\nkeep", "b"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string").selectExpr(
        "doc_id", "text", "pos", "1 as h1", "2 as fp", "3 as n_lines", "4 as keep", "'x' as `id`")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert linededup.dedup_lines(df).columns == df.columns
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "keep" and got[3]["text"] is None
    assert [got[i]["pos"] for i in (1, 2, 3)] == ["a", "b", None]
    bm = linededup.line_keep_bitmaps(df).collect()
    assert len(bm) == 1 and bm[0]["id"] == 2
    assert list(np.unpackbits(np.frombuffer(zlib.decompress(bm[0]["keep"]), np.uint8), count=2)) == [0, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.line_dedup_report(df).collect() == []
    assert linededup.dedup_lines(df).collect() == []
