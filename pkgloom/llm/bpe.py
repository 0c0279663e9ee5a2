"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last eight bytes cuts every text into chunks where its
top bits vanish, so equal passages of different documents give equal chunks
wherever they stand. Chunk hashes are counted over all documents in Spark; the
recurring chunks that save most bytes (``dictionary_bytes`` bounds their texts)
are encoded once and shared with all tasks, any other chunk is encoded where it
first occurs in a task. An encoded chunk keeps the ids of the words that lie
whole within it. The pieces of words cut at its two ends are joined with the
neighbours' pieces, through as many chunks as the word spans, and the join is
encoded anew. White space (ASCII) never lies within a token of a tokenizer that
drops white space, so a join between two white spaces agrees with the encoding
of the whole text; a tokenizer for which that does not hold is refused.

Edge cases: a null text counts as empty; empty texts have no ids; texts without
white space are one join; special tokens written in a text are recognised as
the library does; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, mixed, slices, small_batches, text_bytes

MASK_BITS = 10  # a cut every 1024 bytes on average
MOST = 16_384  # bytes of a chunk at most, but for a character's rest
UNIT_BYTES, CHUNK_BYTES = 48 << 20, 8 << 20  # what a task may remember of pre-tokens and of chunks
ENTRY = 320  # bytes that a remembered entry takes beside its text
# Fixed values of the tokenizer: its normaliser and its pre-token pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNUSUAL = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r\x0b\x0ca-zß-öø-ÿ0-9]+")


def chunk_ends(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted end positions of all chunks, each text's end among them."""
    ends = offs[1:][np.diff(offs) > 0]
    n = len(buf)
    if n >= 9:
        window = np.ndarray((n - 7,), "<u8", buf.tobytes() + b"\0" * 8, strides=(1,))
        cut = np.flatnonzero(mixed(window) >> np.uint64(64 - MASK_BITS) == 0) + 8
        cut = cut[cut < n]
        cut = cut[(buf[cut] & 0xC0) != 0x80]  # never within a character
        text = np.searchsorted(offs, cut, "right") - 1
        cut = cut[cut - offs[text] >= 8]  # the window lies in one text
        ends = np.union1d(ends, cut)
    begins = np.concatenate([offs[:1], ends[:-1]])
    extra = []
    for i in np.flatnonzero(ends - begins > MOST):
        at = int(begins[i]) + MOST
        while at < ends[i]:
            while at < ends[i] and buf[at] & 0xC0 == 0x80:
                at += 1
            if at < ends[i]:
                extra.append(at)
            at += MOST
    return np.union1d(ends, np.array(extra, np.int64)) if extra else ends


def _hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from .common import word_hashes

    offsets = np.concatenate([begins[:1], ends]).astype(np.int32)
    return word_hashes(pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(buf)))


def _pieces(batches: Iterator[pa.RecordBatch]):
    """Per slice: bytes, text offsets, chunk begins and ends, index of each text's first chunk."""
    for batch in slices(batches, "text", 1 << 20):
        buf, offs = text_bytes(batch.column("text"))
        buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
        ends = chunk_ends(buf, offs)
        begins = np.concatenate([offs[:1], ends[:-1]]) if len(ends) else ends
        yield batch, buf, offs, begins, ends


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, buf, _, begins, ends in _pieces(batches):
        if len(ends):
            keys, at, n = np.unique(_hashes(buf, begins, ends), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((ends - begins)[at]), pa.array(n)], ["hash", "size", "n"])


@lru_cache(1)
def _tokenizer(path: str):
    """The tokenizer, read once by a Python worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding(), t.no_truncation()
    return t


def special_tokens(path: str) -> list[str]:
    """The tokenizer's special tokens; an error if its joins can't be told to agree. The driver reads this once for all tasks."""
    spec = json.loads(_tokenizer.__wrapped__(path).to_str())
    shape = (spec["decoder"], spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"], spec["model"]["end_of_word_suffix"])
    if shape != (None, NORMALIZER, {"Regex": PATTERN}, "</w>"):
        raise ValueError("chunk joins need a tokenizer with word ends that lower-cases, drops white space and decodes by joining tokens")
    return [x["content"] for x in spec["added_tokens"]]


class Encoder:
    """Encodes chunks and joins. It remembers the ids of pre-tokens; one per task.

    Texts of ASCII and Latin-1 letters are lower-cased and cut into pre-tokens
    by the tokenizer's own pattern, spelled out for these letters; any other
    word, and one with a special token in it, goes to the tokenizer whole.
    """

    def __init__(self, path: str, specials: list[str]):
        self.tokenizer = t = _tokenizer(path)
        self.names = [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size(with_added_tokens=True))]
        self.last = np.array([n.endswith(b"</w>") for n in self.names])
        self.specials = specials
        self.units: dict[str, bytes] = {}  # ids of a unit
        self.decoded: dict[str, bytes] = {}
        self.silent = False  # whether some unit has no ids
        self.chunks: dict[bytes, tuple] = {}
        self.unit_bytes = self.chunk_bytes = 0

    def _learn_whole(self, words: dict[str, str]) -> None:
        for unit, word in words.items():
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            self.units[unit], self.decoded[unit] = np.array(ids, "<u4").tobytes(), b" ".join([self.names[i] for i in ids])
            self.unit_bytes += len(unit) + len(self.units[unit]) + len(self.decoded[unit]) + ENTRY
            self.silent = self.silent or not ids

    def cut(self, data: bytes) -> list[str]:
        """The units of a text between white space: pre-tokens, or ``\\0`` and a word to encode whole."""
        text = data.decode()
        if not UNUSUAL.search(text) and not any(x in text for x in self.specials):
            return PRETOKEN.findall(text.lower())
        out: list[str] = []
        for word in data.split():
            w = word.decode()
            plain = not UNUSUAL.search(w) and not any(x in w for x in self.specials)
            out += PRETOKEN.findall(w.lower()) if plain else ["\0" + w]
        return out

    def learn(self, lists: list[list[str]]) -> None:
        """Remember all units of ``lists``; the pre-tokens among them are encoded in one text, as each ends with a word end."""
        new = list({u for units in lists for u in units if u not in self.units})
        if self.unit_bytes + len(new) * ENTRY > UNIT_BYTES:
            self.units.clear(), self.decoded.clear()
            self.unit_bytes = 0
            new = list({u for units in lists for u in units})
        plain = [u for u in new if u[0] != "\0"]
        for a in range(0, len(plain), 2048):
            part = plain[a : a + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._learn_whole({u: u for u in part})
                continue
            coded, names = ids.tobytes(), [self.names[i] for i in ids.tolist()]
            for u, lo, hi in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.units[u], self.decoded[u] = coded[4 * lo : 4 * hi], b" ".join(names[lo:hi])
            self.unit_bytes += sum(map(len, part)) + 2 * len(coded) + len(part) * ENTRY
        self._learn_whole({u: u[1:] for u in new if u[0] == "\0"})

    def render(self, units: list[str]) -> tuple[bytes, bytes]:
        if self.silent:
            units = [u for u in units if self.units[u]]
        return b"".join(map(self.units.__getitem__, units)), b" ".join(map(self.decoded.__getitem__, units))

    def chunk_all(self, chunks: list[bytes]) -> None:
        """Encode chunks not known yet: (head, ids, decoded, tail), head and tail being the pieces of words cut at either end; ids None without white space."""
        if self.chunk_bytes > CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        parts = []
        for data in chunks:
            if data in self.chunks:
                continue
            words = data.split(None, 1)
            if not words:
                self.chunks[data] = (b"", b"", b"", b"")
            elif len(words) == 1 and data == words[0]:
                self.chunks[data] = (data, None, b"", b"")
            else:
                head = b"" if data[:1].isspace() else words[0]
                rest = data[len(head) :]
                tail = b"" if data[-1:].isspace() else rest.rsplit(None, 1)[-1]
                parts.append((data, head, self.cut(rest[: len(rest) - len(tail)]), tail))
        self.learn([p[2] for p in parts])
        for data, head, units, tail in parts:
            ids, decoded = self.render(units)
            self.chunks[data] = (head, ids, decoded, tail)
            self.chunk_bytes += len(data) + len(ids) + len(decoded) + ENTRY

    def documents(self, docs: list[list[bytes]], shared: dict[bytes, tuple]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of documents given as their chunks. Words cut by chunk ends are joined and encoded anew."""
        self.chunk_all(list({c for chunks in docs for c in chunks if c not in shared}))
        plans, joins = [], []
        for chunks in docs:
            plan, word = [], b""
            for data in chunks:
                head, ids, decoded, tail = shared.get(data) or self.chunks[data]
                word += head
                if ids is None:
                    continue
                if word:
                    joins.append(self.cut(word))
                    plan.append(joins[-1])
                plan.append((ids, decoded))
                word = tail
            if word:
                joins.append(self.cut(word))
                plan.append(joins[-1])
            plans.append(plan)
        self.learn(joins)
        out = []
        for plan in plans:
            parts = [p if isinstance(p, tuple) else self.render(p) for p in plan]
            out.append((b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[1]])))
        return out


def shared_chunks(docs: DataFrame, path: str, text: str = "text", dictionary_bytes: int = 4 << 20) -> dict[bytes, tuple]:
    """The recurring chunks that save most, encoded once: chunk -> (head, ids, decoded, tail)."""
    spark, specials = docs.sparkSession, special_tokens(path)
    rows = small_batches(docs).select(F.col(text).alias("text"))
    counts = rows.mapInArrow(_chunk_counts, "hash bigint, size bigint, n bigint").groupBy("hash").agg(F.max("size").alias("size"), F.sum("n").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc((F.col("n") - 1) * F.col("size")), "hash").limit(dictionary_bytes >> (MASK_BITS + 1)).toArrow()
    size = np.cumsum(top["size"].to_numpy())
    chosen = np.sort(top["hash"].to_numpy()[size <= dictionary_bytes].astype(np.int64).view(np.uint64))
    if not len(chosen):
        return {}
    handle = spark.sparkContext.broadcast(chosen)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, _, begins, ends in _pieces(batches):
            if len(ends):
                keys, at = np.unique(_hashes(buf, begins, ends), return_index=True)
                slot = np.minimum(np.searchsorted(handle.value, keys), len(handle.value) - 1)
                at = at[handle.value[slot] == keys]
                yield pa.RecordBatch.from_arrays([pa.array([buf[begins[i] : ends[i]].tobytes() for i in at], pa.binary())], ["chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, specials)
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            encoder.chunk_all(chunks)
            done = [(c, *encoder.chunks[c]) for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.binary()) for i in range(5)], ["chunk", "head", "ids", "decoded", "tail"])

    found = rows.mapInArrow(texts, "chunk binary").distinct().mapInArrow(encoded, "chunk binary, head binary, ids binary, decoded binary, tail binary").toArrow()
    return {r["chunk"]: (r["head"], r["ids"], r["decoded"], r["tail"]) for r in found.to_pylist()}


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, dictionary_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` columns plus ``n_tokens``, ``ids`` (array<int>, if asked), ``ids_sha256`` and ``decoded_sha256``."""
    handle, specials = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, text, dictionary_bytes)), special_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shared = Encoder(path, specials), handle.value
        for batch, buf, offs, begins, ends in _pieces(batches):
            data = buf.tobytes()
            stops = np.searchsorted(ends, offs[1:], "right").tolist()
            chunks = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            done = encoder.documents([chunks[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], shared)
            n = [len(coded) // 4 for coded, _ in done]
            one, two = [hashlib.sha256(coded).hexdigest() for coded, _ in done], [hashlib.sha256(decoded).hexdigest() for _, decoded in done]
            ids = [np.frombuffer(coded, "<u4").astype(np.int32) for coded, _ in done] if with_ids else []
            extra = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64()), *extra, pa.array(one), pa.array(two)], [*keep, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    ddl = f"{field_ddl(docs, *keep)}, n_tokens bigint, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string"
    return docs.select(*keep, F.col(text).alias("text")).mapInArrow(run, ddl)
