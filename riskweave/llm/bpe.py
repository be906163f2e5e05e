"""Byte-level BPE encoding and decoding with forced boundaries.

The vocabulary file (its path is a parameter) is read once on the driver and
broadcast; it has a fixed size. A text is cut at the strings of added tokens,
each remaining part into pieces by the byte-level split pattern, and each piece
at its forced boundaries: a pair of neighbouring bytes that occurs inside no
token of the vocabulary can never be merged across, so a cut there is certain.
The fragments are encoded independently by merging the pair of least rank first
(leftmost on ties), and the ids are concatenated. Pieces repeat often, so each
worker keeps a bounded table of those it has encoded. Decoding
joins the tokens' bytes and reads them as UTF-8.

Short fragments are merged by scanning, long ones with a heap over a linked
list, so a text without any boundary costs n log n.

Ids and ranks are packed in 32 bits each. ``load`` refuses (``ValueError``) a file that
asks for what is not built: a normaliser, another pre-tokeniser, other model options, or
added tokens that swallow blanks or match whole words only.

Defined cases: a null or empty text encodes to no ids and decodes to the empty
string. Every row gives one row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.llm import textbits as tb

# Fixed value: the split pattern of this kind of vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE_LIMIT = 200_000                            # of each half of a worker's table
NEVER = 1 << 64                                  # above every packed rank: no merge
FORCED = NEVER + 1                               # and no token holds this pair of bytes: a certain cut
_CODECS: dict[str, Codec] = {}                   # per worker process, so that its tables outlive a task


def byte_letters() -> list[str]:
    """The printable letter that the vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        to_byte = {c: i for i, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.first = [vocab[c] for c in letters]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.packed = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.pairs = [FORCED] * (1 << 16)                # what a pair of bytes merges to, if a token holds it at all
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:]):
                self.pairs[a << 8 | b] = self.packed.get(self.first[a] << 32 | self.first[b], NEVER)
        self.key = hashlib.sha256(repr((sorted(vocab.items()), merges, sorted(self.added.items()))).encode()).hexdigest()
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.names = {i: b"%d," % i for i in self.bytes_of}
        self._start()

    def _start(self):
        self.split = regex.compile(SPLIT)
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}                   # pieces of the part at hand that decode to other bytes

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "around", "pieces", "older", "odd")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _merge_short(self, ids: list[int], best: list[int]) -> list[int]:
        """Merges by rank; ``best[i]`` holds rank and result of the pair at i."""
        get = self.packed.get
        while best:
            least = min(best)
            if least == NEVER:
                break
            i = best.index(least)
            ids[i:i + 2] = [new] = [least & 0xFFFFFFFF]
            del best[i]
            if i < len(best):
                best[i] = get(new << 32 | ids[i + 1], NEVER)
            if i:
                best[i - 1] = get(ids[i - 1] << 32 | new, NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merge = len(ids), self.packed
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue                                    # one of the two has been merged meanwhile
            ids[i], ids[j] = best & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merge.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (m, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        """Cuts at the forced boundaries, encodes the fragments alone and joins their ids."""
        raw = piece.encode()
        pairs = self.pairs
        best = [pairs[a << 8 | b] for a, b in zip(raw, raw[1:])]
        first = self.first
        ids = [first[b] for b in raw]
        out: list[int] = []
        lo = 0
        while True:
            try:
                hi = best.index(FORCED, lo)
            except ValueError:
                hi = len(best)
            if hi - lo < 48:
                out += self._merge_short(ids[lo:hi + 1], best[lo:hi])
            else:
                out += self._merge_long(ids[lo:hi + 1])
            if hi >= len(best):
                return out
            lo = hi + 1

    def _known(self, piece: str) -> bytes:
        """The ids of a piece as text with a comma after each. What they decode to is kept, in ``odd``,
        only where it is not the piece itself; such a piece is never held in the table."""
        got = self.older.get(piece)
        if got is None:
            ids = self.encode_piece(piece)
            name, token = self.names, self.bytes_of
            got = b"".join([name[i] for i in ids])
            if (raw := b"".join([token[i] for i in ids])) != piece.encode():
                self.odd[piece] = raw
                return got
        if len(piece) <= 64:
            if len(self.pieces) >= TABLE_LIMIT:            # the older half goes, pieces in use come back
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def parts(self, text: str) -> list[str]:
        return [text] if self.around is None or not self.around.search(text) else self.around.split(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                for piece in self.split.findall(part):
                    out.extend(self.encode_piece(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def round_trip(self, text: str) -> tuple[str, str]:
        """The ids as decimal text joined by commas, and the text decoded from them."""
        names, raw = [], []
        for part in self.parts(text):
            if part in self.added:
                i = self.added[part]
                names.append(self.names[i])
                raw.append(self.bytes_of[i])
                continue
            pieces = self.split.findall(part)
            for p in pieces:                             # the table may turn over in between
                names.append(self.pieces.get(p) or self._known(p))
            if self.odd:
                raw += [self.odd.get(p) or p.encode() for p in pieces]
                self.odd.clear()
            else:
                raw.append("".join(pieces).encode())
        return b"".join(names)[:-1].decode(), b"".join(raw).decode("utf-8", "replace")


def unsupported(spec: dict) -> list[str]:
    """What a vocabulary file asks for that this codec would not do."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    out = [name for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                             "ignore_merges") if model.get(name)]
    if model.get("type", "BPE") != "BPE":
        out.append("model type")
    if spec.get("normalizer"):
        out.append("normalizer")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        out.append("pre_tokenizer")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        out.append("decoder")
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        out.append("added_tokens")
    return out


def load(path: str) -> Codec:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if wrong := unsupported(spec):
        raise ValueError(f"{path}: not supported: {', '.join(wrong)}")
    return Codec(spec)


def _here(key: str, shared) -> Codec:
    if key not in _CODECS:
        _CODECS[key] = shared.value
    return _CODECS[key]


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, decoded), one row per row of ``docs``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(codec), codec.key
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    names = schema.fieldNames()

    def run(batches):
        c = _here(key, shared)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array([c.decode(x) for x in ids], pa.string())], names=names)

    return tb.bound_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def round_trip_report(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(codec), codec.key
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    names = schema.fieldNames()

    def run(batches):
        c = _here(key, shared)
        for b in batches:
            n, sha, back = [], [], []
            for value in b.column(1):
                ids, text = c.round_trip(value.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(back, pa.string())], names=names)

    return tb.bound_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
