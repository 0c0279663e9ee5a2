"""Cross-tokenizer alignment with an identity-map fast path.

Both tokenizers cut the same bytes, a space and the text. Offsets where a token
of either ends cut the tokens into groups, and the two tokens that end a group
are linked. An array made once maps every A id to the B id of the same bytes.
A group of one token each, whose ids the map joins, is counted in a vector as
long as A's vocabulary; only the links of other groups become id pairs, counted
within a slice of texts before they are shuffled. The pair counts go back to the
slices by a join on the pair, each pair once a slice, so neither a frequent pair
nor a frequent text makes a hot key; the vectors are as long as the vocabularies
at any corpus size and are broadcast.

Edge cases: texts that are null or empty, or whose tokens' bytes are not the
space and the text (the normaliser of B changes some), have no tokens, zeros and
an empty digest; special tokens written in a text are plain text; repeated rows
count each time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, field_ddl, slices, small_batches

SLICE = 512 << 10  # bytes of text in a slice; its row is half as large again
GROUP = 16  # slices that a reader or writer of their table holds at once


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others count on from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.load(open(path_a, encoding="utf-8"))
        letters = byte_alphabet()
        ids = {bytes(letters[c] for c in entry): i for entry, i in spec["model"]["vocab"].items()}
        self.bytes_a = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for data, i in ids.items():
            self.bytes_a[i] = data
        self.quick = self._ranked(spec, ids)
        self.library = None
        if not self.quick:
            self.library = Tokenizer.from_file(path_a)
            self.library.encode_special_tokens = True
            self.library.no_padding(), self.library.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        same = {data: i for i, data in reversed(list(enumerate(self.bytes_b))) if not self.b.is_byte(i)}
        same = {self.bytes_b[i]: i for i in range(len(self.bytes_b)) if self.b.is_byte(i)} | same  # a byte id where no piece has the bytes
        self.identity = np.array([same.get(data, -1) if data else -1 for data in self.bytes_a])
        self.names = [pa.array([f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"])]

    @staticmethod
    def _ranked(spec: dict, ids: dict[bytes, int]):
        """The same encoding by ranks, several times as fast, if the vocabulary lists bytes first and then merges in order; else None."""
        import public_tokenizers
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges)
        plain = not spec["normalizer"] and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not (model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"))
        if in_order and plain:
            return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        return None

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
        """Ids of both for every text; None where either's bytes are not a space and the text."""
        one, two = self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)
        out_a, out_b = [], []
        for text, a, b in zip(texts, one, two, strict=True):
            whole = (" " + text).encode()
            fine = bool(text) and b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out_a.append(np.array(a, np.int32) if fine else None)
            out_b.append(np.array(b, np.int32) if fine else None)
        return out_a, out_b


@lru_cache(2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def aligned(pair: Pair, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Groups of two tokenizations of the same bytes: the linked ids, which links are plain, the end of every group and the groups' digest text."""
    end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    at = np.searchsorted(end_b, end_a)
    last_a = np.flatnonzero(end_b[at] == end_a)  # tokens of a that end a group
    last_b = at[last_a]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    link_a, link_b = a[last_a], b[last_b]
    plain = (n_a == 1) & (n_b == 1) & (pair.identity[link_a] == link_b)
    # the digest text: a's tokens of a group, then b's, each with its mark behind it
    codes = np.empty(len(a) + len(b), np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    codes[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = a * 3 + mark_a
    codes[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = b * 3 + mark_b
    return {"a": link_a, "b": link_b, "plain": plain, "end": end_a[last_a], "codes": codes, "code_end": np.cumsum(n_a + n_b)}


SLICE_SCHEMA = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("n_links", pa.list_(pa.int64())), ("links", pa.binary()), ("plain_ids", pa.list_(pa.int32())), ("plain_n", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int64()))])
SLICE_DDL = "part bigint, docs binary, n_links array<bigint>, links binary, plain_ids array<int>, plain_n array<bigint>, pairs array<bigint>, pair_n array<bigint>"


def sliced(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """A row for each slice of (key, text, part): its texts' results but for the counts, their links, and what the slice counts."""
    pair = pair_of(path_a, path_b)
    for piece in slices(batches, "text", SLICE):
        texts = piece.column("text").fill_null("").to_pylist()
        ids_a, ids_b = pair.encoded(texts)
        real = [i for i, x in enumerate(ids_a) if x is not None]
        n_a, n_b, groups, digest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
        links, pairs, pair_n, plain = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(pair.bytes_a), np.int64)
        if real:
            n_a[real], n_b[real] = [len(ids_a[i]) for i in real], [len(ids_b[i]) for i in real]
            got = aligned(pair, np.concatenate([ids_a[i] for i in real]), np.concatenate([ids_b[i] for i in real]))
            stops = np.cumsum([len(texts[i].encode()) + 1 for i in real])
            upto = np.searchsorted(got["end"], stops) + 1  # groups to the end of each text
            groups[real] = np.diff(upto, prepend=0)
            spelled = pair.names[0].take(pa.array(got["codes"]))
            offs, data = np.frombuffer(spelled.buffers()[1], np.int32), spelled.buffers()[2]
            edges = [0, *offs[got["code_end"][upto - 1]].tolist()]
            for i, lo, hi in zip(real, edges[:-1], edges[1:], strict=True):
                digest[i] = hashlib.sha256(data[lo : hi - 1]).hexdigest()
            fast = got["plain"]
            plain = np.bincount(got["a"][fast], minlength=len(plain))
            keys = got["a"][~fast].astype(np.int64) << 32 | got["b"][~fast]
            pairs, at, pair_n = np.unique(keys, return_inverse=True, return_counts=True)
            links = np.empty(len(fast), np.int32)
            links[fast], links[~fast] = got["a"][fast], -1 - at  # an id of a, or a place among the slice's pairs
        own = pa.record_batch({"key": piece.column("key"), "n_a": n_a, "n_b": n_b, "n_groups": groups, "groups_sha256": pa.array(digest)})
        seen = np.flatnonzero(plain)
        out = [piece.column("part")[0].as_py(), _table(own), groups, links.tobytes(), seen.astype(np.int32), plain[seen], pairs, pair_n]
        yield pa.RecordBatch.from_arrays([pa.array([x], field.type) for x, field in zip(out, SLICE_SCHEMA, strict=True)], SLICE_SCHEMA.names)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    pair_kind = docs.schema[key].dataType
    spark = docs.sparkSession

    # a slice goes by the place of its first row, so that a task made anew names it as before
    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("part", F.monotonically_increasing_id())
    # Spark reads a row group in one batch, so a group of the usual 128 MB takes several times that in every task
    done = cut(rows.mapInArrow(lambda batches: sliced(batches, path_a, path_b), SLICE_DDL), "alignment", **{"parquet.block.row.count.limit": GROUP})

    counts = done.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_n").alias("n"))
    counts = cut(counts, "pairs")
    plain = done.select(F.explode(F.arrays_zip("plain_ids", "plain_n")).alias("p")).groupBy(F.col("p.plain_ids").alias("a")).agg(F.sum("p.plain_n").alias("n")).toArrow()  # a row an A id at most
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()  # a row a B id at most
    vectors = spark.sparkContext.broadcast(_vectors(plain, most, path_a, path_b))

    asked = done.select("part", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("answer"))  # as many as the slice has pairs
    both = done.select("part", "docs", "n_links", "links", "pairs").join(answers, "part", "left").select("docs", "n_links", "links", "pairs", F.coalesce(F.col("answer.n"), F.array().cast("array<bigint>")).alias("counts"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_a, best = vectors.value
        identity = pair_of(path_a, path_b).identity
        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.ipc.open_stream(batch.column("docs")[i].as_py()).read_all()
                links = np.frombuffer(batch.column("links")[i].as_py(), np.int32)
                pairs, found, n_links = (np.array(batch.column(c)[i].values.to_numpy(), np.int64) for c in ("pairs", "counts", "n_links"))
                fast = links >= 0
                count, b = np.empty(len(links), np.int64), np.empty(len(links), np.int64)
                count[fast], b[fast] = by_a[links[fast]], identity[links[fast]]
                at = -1 - links[~fast]
                count[~fast], b[~fast] = found[at], pairs[at] & 0xFFFFFFFF
                upto = np.concatenate([[0], np.cumsum(n_links)])
                sums, tops = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count == best[b]))
                columns = [own["key"].combine_chunks(), *(own[c].combine_chunks() for c in ("n_a", "n_b", "n_groups")), pa.array(n_links), pa.array(np.diff(tops[upto]).astype(np.int64)), pa.array(np.diff(sums[upto])), own["groups_sha256"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    ddl = f"`key` {pair_kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return both.mapInArrow(finished, ddl).withColumnRenamed("key", key)


def _table(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _vectors(plain: pa.Table, most: pa.Table, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the plain links by A id, and the highest count of every B id over all its links."""
    pair = pair_of(path_a, path_b)
    by_a, best = np.zeros(len(pair.bytes_a), np.int64), np.zeros(len(pair.bytes_b), np.int64)
    by_a[plain["a"].to_numpy()] = plain["n"].to_numpy()
    best[most["b"].to_numpy()] = most["n"].to_numpy()
    seen = np.flatnonzero(by_a)
    np.maximum.at(best, pair.identity[seen], by_a[seen])
    return by_a, best
