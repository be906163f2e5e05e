"""Quality rules by line-first cleaning.

Every line of a text is judged by itself, lines that fail are removed, and a
document is rejected when the removal takes too much of it. A line ends at
``\\n``; a word is a maximal run outside ``[\\x20\\x09-\\x0D]``. A line without a
word is neutral: it stays, and counts for nothing. A line with words fails when
one of these holds (``Rules`` has the numbers):

``symbols``     more than ``symbols_pct`` characters of ``[#*$%&|<>]`` per 100 words:
                menus cut by bars, crumbs, marked-up residue.
``shouting``    at least ``shout_words`` words, and more than ``shout_pct`` exclamation
                marks per 100 words, or more than ``caps_pct`` per cent of its ASCII
                letters are capitals.
``unfinished``  its last word does not end in ``END`` and it has under ``short_words``
                words or no character of ``[.,;:!?]``: headings, navigation entries, lists.
``monotone``    at least ``mono_words`` words, of which under ``mono_pct`` per cent differ.
``boilerplate`` holds one of ``PHRASES`` (notices, licences, cookie and sign-up bars), any case.
``again``       equal to an earlier line of the same text.

The document is kept when the base rules hold (``n_words`` >= ``min_words``, and at
most ``max_repeat_pct`` per cent of the words lie in a 3-word window found twice or
more in the text) and the lines left hold at least ``min_left_pct`` per cent of the
characters in words.

``clean`` returns one row per input row; texts are read whole, in ``mapInArrow`` over
numpy bytes, without a shuffle. Lines and windows are compared by 64-bit hashes
within one text.

Defined cases: a null text has no words and one line, gives an empty cleaned text
and fails the base rules; an empty text likewise. Null, repeated or missing-from-
elsewhere ids are carried along untouched, repeated rows give repeated rows, an
empty table an empty result. Only the id and text columns are read, so columns of
other names cannot clash. Very long texts are processed whole; memory follows the
longest text of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import textbits as tb

U64 = np.uint64


@dataclass(frozen=True)
class Rules:
    symbols_pct: int = 30
    shout_words: int = 3
    shout_pct: int = 50
    caps_pct: int = 60
    short_words: int = 6
    mono_words: int = 12
    mono_pct: int = 25
    min_words: int = 50
    max_repeat_pct: int = 50
    min_left_pct: int = 50


#: A finished line's last word ends in one of these characters.
END = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "…", "»", "”", "’", "。", "！", "？")

#: Notices that no article is made of, lower case, in the languages of the corpus.
PHRASES = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "accept cookies", "uses cookies", "click here", "sign up for", "subscribe to",
    "log in to", "enable javascript", "skip to content", "back to top", "share this",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "suscríbete a",
)

RULES = ("symbols", "shouting", "unfinished", "monotone", "boilerplate", "again")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOL, BANG, STOP = _flags(b"#*$%&|<>"), _flags(b"!"), _flags(b".,;:!?")
UPPER, LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
UPPER[65:91] = LETTER[65:91] = LETTER[97:123] = True
PHRASE = re.compile("|".join(re.escape(p) for p in PHRASES).encode())
ENDINGS = tuple(e.encode() for e in END)


def _ends_well(buf: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each range of bytes ends in one of END."""
    out = np.zeros(len(end), dtype=bool)
    for e in ENDINGS:
        fits = end - start >= len(e)
        for k, byte in enumerate(e):
            fits &= buf[np.maximum(end - len(e) + k, 0)] == byte
        out |= fits
    return out


def _again(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks each (group, hash) that an earlier position holds too; ``group`` ascends."""
    out = np.zeros(len(h), dtype=bool)
    order = np.lexsort((h, group))
    g, v = group[order], h[order]
    out[order[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return out


def judge(buf: np.ndarray, offs: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Counts per text and a verdict per line of the texts ``buf[offs[i]:offs[i + 1]]``.

    Lines are given by ``line_start``, ``line_end`` (without the line feed), ``line_text``;
    ``failed`` holds the number of the first failing rule plus one, or 0."""
    n = len(offs) - 1
    start, end, text = tb.runs(~tb.SPACE[buf], offs)
    n_words = np.bincount(text, minlength=n)
    acc = {k: np.r_[0, np.cumsum(v)] for k, v in {
        "chars": (buf & 0xC0 != 0x80) & ~tb.SPACE[buf], "symbols": SYMBOL[buf], "bangs": BANG[buf],
        "stops": STOP[buf], "upper": UPPER[buf], "letters": LETTER[buf]}.items()}

    def total(name, a, b):
        return acc[name][b] - acc[name][a]

    hasher = tb.RangeHasher(buf)
    h = hasher(start, end)
    # words inside a 3-word window that its text holds twice or more
    at = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
    tri = tb.mix(tb.mix(tb.mix(h[at]) + h[at + 1]) + h[at + 2])
    order = np.lexsort((tri, text[at]))
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = (tri[order][1:] == tri[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
    twice = at[order[same[:-1] | same[1:]]]
    repeated = np.zeros(len(h), dtype=bool)
    for k in range(3):
        repeated[twice + k] = True

    # lines: cut after every line feed and at every text's end
    feed = np.flatnonzero(buf == 0x0A)
    line_start = np.concatenate([offs[:-1], feed + 1])
    line_end = np.concatenate([offs[1:], feed])
    line_text = np.concatenate([np.arange(n), np.searchsorted(offs, feed, side="right") - 1])
    line_start = line_start[np.lexsort((line_start, line_text))]
    line_end = line_end[np.lexsort((line_end, line_text))]
    line_text = np.sort(line_text)
    first = np.searchsorted(start, line_start)        # the line's words are first:last
    last = np.searchsorted(start, line_end)
    words = last - first
    lives = words > 0
    line_of = np.repeat(np.arange(len(words)), words)
    differing = words - np.bincount(line_of, weights=_again(line_of, h), minlength=len(words)).astype(np.int64)
    again = np.zeros(len(words), dtype=bool)
    again[lives] = _again(line_text[lives], hasher(line_start[lives], line_end[lives]))
    tail = np.maximum(last - 1, 0)
    finished = np.zeros(len(words), dtype=bool)
    finished[lives] = _ends_well(buf, end[tail[lives]], start[tail[lives]])
    phrase = np.zeros(len(words), dtype=bool)
    order_key = line_text * (len(buf) + 1) + line_start
    for m in PHRASE.finditer(_lower(buf)):
        a, b = m.span()
        t = np.searchsorted(offs, a, side="right") - 1
        if b <= offs[t + 1]:                          # a phrase has no line feed: one line holds it
            phrase[np.searchsorted(order_key, t * (len(buf) + 1) + a, side="right") - 1] = True

    caps = 100 * total("upper", line_start, line_end) > rules.caps_pct * total("letters", line_start, line_end)
    shout = 100 * total("bangs", line_start, line_end) > rules.shout_pct * words
    verdicts = [
        100 * total("symbols", line_start, line_end) > rules.symbols_pct * words,
        (words >= rules.shout_words) & (shout | caps),
        ~finished & ((words < rules.short_words) | (total("stops", line_start, line_end) == 0)),
        (words >= rules.mono_words) & (100 * differing < rules.mono_pct * words),
        phrase,
        again,
    ]
    failed = np.zeros(len(words), dtype=np.int64)
    for k in range(len(verdicts) - 1, -1, -1):
        failed[verdicts[k] & lives] = k + 1

    def per_text(values, where):
        return np.bincount(line_text[where], weights=values[where], minlength=n).astype(np.int64)

    line_chars = total("chars", line_start, line_end)
    n_repeat = np.bincount(text, weights=repeated, minlength=n).astype(np.int64)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_pct * n_words)
    word_chars = total("chars", offs[:-1], offs[1:])
    left = per_text(line_chars, failed == 0)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": total("symbols", offs[:-1], offs[1:]),
        "n_dup_lines": per_text(again, again), "n_repeat_words": n_repeat, "base_failed": base_failed,
        "left_chars": left, "n_lines": np.bincount(line_text, minlength=n),
        "n_failed": per_text(failed > 0, failed > 0),
        "kept": ~base_failed & (100 * left >= rules.min_left_pct * word_chars),
        "line_start": line_start, "line_end": line_end, "line_text": line_text, "failed": failed,
    }


def _lower(buf: np.ndarray) -> bytes:
    """Lower case for A-Z and the two-byte Latin capitals, so that PHRASES fit any case."""
    return tb.fold_latin(buf).tobytes()


def _cleaned(buf: np.ndarray, offs: np.ndarray, found: dict[str, np.ndarray]) -> list[bytes]:
    raw, out = buf.tobytes(), []
    edge = np.searchsorted(found["line_text"], np.arange(len(offs)))
    for i in range(len(offs) - 1):
        a, b = edge[i], edge[i + 1]
        bad = found["failed"][a:b] > 0
        if not bad.any():
            out.append(raw[offs[i]:offs[i + 1]])
            continue
        good = np.flatnonzero(~bad) + a
        out.append(b"\n".join(raw[s:e] for s, e in zip(found["line_start"][good], found["line_end"][good])))
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed", "left_chars")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: the id, ``cleaned`` (the lines that passed, joined by ``\\n``),
    the counts of COUNTS, ``base_failed``, ``kept`` and ``failed_by``, the number of
    lines that each rule of RULES was the first to fail."""
    rows = tb.bound_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    out = T.StructType([rows.schema["id"], T.StructField("cleaned", T.StringType())]
                       + [T.StructField(c, T.LongType()) for c in COUNTS]
                       + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
                          T.StructField("failed_by", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in tb.chunks(batch.column(1)):
                n = len(offs) - 1
                found = judge(buf, offs, rules)
                by = np.zeros((n, len(RULES)), dtype=np.int64)
                bad = found["failed"] > 0
                np.add.at(by, (found["line_text"][bad], found["failed"][bad] - 1), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(_cleaned(buf, offs, found), pa.binary()).cast(pa.string())]
                    + [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                    + [pa.array(found["base_failed"]), pa.array(found["kept"]), pa.array(list(by), pa.list_(pa.int64()))],
                    names=out.fieldNames())

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(id, cleaned text) of the documents that are kept."""
    done = clean(docs, id_col, text_col, rules)
    return done.filter("kept").select(id_col, F.col("cleaned").alias(text_col))


def rule_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    return clean(docs, id_col, text_col, rules).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_failed", "left_chars")


def _phrases_sql() -> str:
    return " OR ".join(f"contains(low, '{p.replace(chr(39), chr(39) * 2)}')" for p in PHRASES)


def oracle_sql(rules: Rules = Rules()) -> str:
    """The same report in DuckDB SQL (on texts without capitals beyond U+00DE)."""
    ends = ", ".join("'" + e.replace("'", "''") + "'" for e in END)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM wins),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY doc_id),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
raw_lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM cut),
lines AS (
  SELECT doc_id, pos, line, lower(line) AS low,
         list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM raw_lines),
judged AS (
  SELECT doc_id, again, len(array_to_string(w, '')) AS chars,
    100 * len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {rules.symbols_pct} * len(w)
    OR (len(w) >= {rules.shout_words}
        AND (100 * len(regexp_replace(line, '[^!]', '', 'g')) > {rules.shout_pct} * len(w)
             OR 100 * len(regexp_replace(line, '[^A-Z]', '', 'g')) > {rules.caps_pct} * len(regexp_replace(line, '[^A-Za-z]', '', 'g'))))
    OR (right(w[-1], 1) NOT IN ({ends}) AND (len(w) < {rules.short_words} OR NOT regexp_matches(line, '[.,;:!?]')))
    OR (len(w) >= {rules.mono_words} AND 100 * len(list_distinct(w)) < {rules.mono_pct} * len(w))
    OR {_phrases_sql()}
    OR again AS failed
  FROM lines WHERE len(w) > 0),
per_doc AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (failed) AS n_failed,
         coalesce(sum(chars) FILTER (NOT failed), 0)::BIGINT AS left_chars
  FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_failed, 0) AS n_failed, coalesce(left_chars, 0) AS left_chars
  FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed, left_chars,
       n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words)
         AND 100 * left_chars >= {rules.min_left_pct} * word_chars AS kept
FROM base
"""
