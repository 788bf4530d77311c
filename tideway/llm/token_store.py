"""Token-id output: whole texts to ids, ids to Huffman blocks in document order, blocks back to ids."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway.llm.huffman import Decoder, Encoder, block_size, code_lengths
from tideway.llm.shared import discard, materialize, new_folder, partitions, read_files, slices, text_or_empty, write_files

IDS_SCHEMA = "pid int, doc_id long, n_tokens long, at long, ids binary, counts binary"
BLOCK_SCHEMA = "place string, start long, block binary"
#: Fixed value: how the word-end BPE cuts lower-case text into words; white space is dropped.
WORD_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces whose words Arrow cuts as that pattern does: no apostrophe, no special token, one code point for each letter.
PLAIN = r"^[!-&(-;=-~\x{C0}-\x{FF}]+$"
PLAIN_CUTS = r"([0-9]|[^\p{L}0-9]+)"
#: Bytes of words (each with its ids counted as 100) that a worker keeps in one of its two generations.
KEPT = 16 << 20
_encoders: dict = {}


def _ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first[k] : first[k] + size[k]] of all k, in one array."""
    end = np.cumsum(size)
    return flat[np.repeat(first - (end - size), size) + np.arange(end[-1])] if len(size) else flat[:0]


class TextEncoder:
    """Ids of texts by the tokenizers library; a worker encodes a word once while it stays among the words kept.

    Where the tokenizer drops white space, lowers case, cuts words by ``WORD_CUTS`` and marks their ends, a text's ids
    are those of its words in turn. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        self.by_words = self._cuts_words(state)
        if self.by_words:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[k for w, k in state["model"]["vocab"].items() if w.endswith(state["model"]["end_of_word_suffix"])]] = True
        self.old, self.new = _Words(), _Words()

    @staticmethod
    def _cuts_words(state: dict) -> bool:
        normal, pre, model = state.get("normalizer") or {}, state.get("pre_tokenizer") or {}, state["model"]
        steps, cuts = normal.get("normalizers", []), pre.get("pretokenizers", [])
        return (
            model.get("type") == "BPE"
            and bool(model.get("end_of_word_suffix"))
            and not model.get("dropout")
            and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback"))
            and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and steps[1]["content"] == " "
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": WORD_CUTS}
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
            and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in state.get("added_tokens", []))
            and state.get("truncation") is None
        )

    def _lists(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each) of texts encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(size.sum())), size

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that are plain: as one text, cut where a word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._lists(words)

    def _word_ids(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, place of each word's first, number of its ids)."""
        if self.new.held > KEPT:
            self.old, self.new = self.new, _Words()
        at = np.fromiter((self.new.place.get(w, -1) for w in words), np.int64, len(words))
        lacking = np.flatnonzero(at < 0).tolist()
        before = [k for k in lacking if words[k] in self.old.place]
        own = np.array([self.old.place[words[k]] for k in before], np.int64)
        if before:
            self.new.add([words[k] for k in before], _ragged(self.old.ids, self.old.first[own], self.old.size[own]), self.old.size[own])
        unseen = [k for k in lacking if words[k] not in self.new.place]
        for part, encode in (([k for k in unseen if plain[k]], self._joined), ([k for k in unseen if not plain[k]], self._lists)):
            for a in range(0, len(part), 20_000):
                some = [words[k] for k in part[a : a + 20_000]]
                self.new.add(some, *encode(some))
        if lacking:
            at[lacking] = [self.new.place[words[k]] for k in lacking]
        return self.new.ids, self.new.first[at], self.new.size[at]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each followed by ``end_id``; ids of each text)."""
        if self.by_words:
            split = pc.ascii_split_whitespace(texts)
            bounds = split.offsets.to_numpy().astype(np.int64)
            coded = pc.dictionary_encode(split.values[bounds[0] : bounds[-1]])
            pieces, piece = coded.dictionary, coded.indices.to_numpy()
            plain = pc.match_substring_regex(pieces, PLAIN)
            cut = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(pieces), PLAIN_CUTS, r" \1 "), pieces)
            parts = pc.ascii_split_whitespace(pc.ascii_trim(cut, " "))
            upto = parts.offsets.to_numpy().astype(np.int64)
            words = pc.dictionary_encode(parts.values[upto[0] : upto[-1]])
            word = words.indices.to_numpy()
            is_plain = np.zeros(len(words.dictionary), bool)
            is_plain[word] = np.repeat(plain.to_numpy(zero_copy_only=False), np.diff(upto))
            flat, first, size = self._word_ids(words.dictionary.to_pylist(), is_plain)
            of_words = np.concatenate(([0], np.cumsum(size[word])))
            flat = _ragged(flat, first[word], size[word])  # the ids of each distinct piece
            upto -= upto[0]
            first, size = of_words[upto[:-1]], of_words[upto[1:]] - of_words[upto[:-1]]
            out = _ragged(flat, first[piece], size[piece])
            of_pieces = np.concatenate(([0], np.cumsum(size[piece])))
            bounds -= bounds[0]
            n = of_pieces[bounds[1:]] - of_pieces[bounds[:-1]]
        else:
            out, n = self._lists(texts.to_pylist())
        both = np.empty(len(out) + len(n), np.uint32)
        ends = np.cumsum(n + 1) - 1
        own = np.ones(len(both), bool)
        own[ends] = False
        both[own], both[ends] = out, end_id
        return both, n + 1


class _Words:
    """Words with their ids: one flat array of ids, and where each word's are."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.first, self.size, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(size) - size))
        self.ids, self.size = np.concatenate((self.ids, ids.astype(np.uint32))), np.concatenate((self.size, size))
        self.held += sum(map(len, words)) + 100 * len(words)


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in turn, each followed by ``end_id``; ids of each text), by this worker's encoder of the file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path].encode(texts, end_id)


def token_ids(docs: DataFrame, path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Table of ids in range partitions by doc_id; each partition's last row has its counts of ids."""
    wide = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["pid", "doc_id", "n_tokens", "at", "ids", "counts"]
        total, at, pid = np.zeros(vocabulary, np.int64), 0, None
        for whole in batches:
            for batch in slices(whole, "text"):
                pid = batch.column("pid")[0].as_py()
                ids, n = encode_texts(batch.column("text"), path, end_id)
                total += np.bincount(ids, minlength=vocabulary)
                upto = np.concatenate(([0], np.cumsum(n)))
                raw, w = ids.astype(wide).tobytes(), np.dtype(wide).itemsize
                rows = [raw[a * w : b * w] for a, b in zip(upto[:-1], upto[1:], strict=True)]
                cols = [batch.column("pid"), batch.column("doc_id"), pa.array(n), pa.array(at + upto[:-1]), pa.array(rows, pa.binary()), pa.nulls(len(n), pa.binary())]
                at += int(upto[-1])
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names)
        pa.default_memory_pool().release_unused()  # the worker outlives its task
        if pid is not None:
            seen = np.flatnonzero(total)
            packed = seen.astype("<i8").tobytes() + total[seen].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([pid, None, None, None, None, packed], kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # texts begin differently, so that rows of one doc_id, as of null, fill several ranges
    placed = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return materialize(placed.select(F.spark_partition_id().alias("pid"), "doc_id", "text").mapInArrow(run, IDS_SCHEMA), "ids")


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the corpus; at most a row per id of the vocabulary reaches the driver."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("counts").to_pylist():
                both = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["id", "n"])

    found = ids.filter("counts IS NOT NULL").select("counts").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


class TokenStore(NamedTuple):
    """A stored corpus: ``folder``/code has the code lengths, ``folder``/blocks its files.

    A file lies in a folder place=..., the number of ids before it in 19 digits, and holds blocks of whole documents in
    turn, each followed by a line feed. So files by path, and blocks in a file, are in ascending order of doc_id.
    """

    spark: SparkSession
    folder: str


def write_blocks(ids: DataFrame, lengths: np.ndarray, vocabulary: int, block_ids: int = 1 << 16) -> TokenStore:
    """Write the ids as files of blocks.

    A block ends once it has ``block_ids`` ids; its ``start`` is the number of ids in all documents before it. A task has
    runs of documents that follow each other, each a file of its own.
    """
    wide = "<u2" if vocabulary <= 1 << 16 else "<u4"
    thin = ids.filter("counts IS NULL").groupBy("pid").agg(F.sum("n_tokens").alias("n"))  # a row per partition
    starts = thin.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = ids.filter("counts IS NULL").join(F.broadcast(starts), "pid").select((F.col("base") + F.col("at")).alias("start"), "doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, docs, counts, parts, first, held, place = Encoder(lengths), [], [], [], 0, 0, None

        def flush() -> pa.RecordBatch:
            data = encoder.block(docs, np.array(counts), np.frombuffer(b"".join(parts), wide).astype(np.int64), first)
            return pa.RecordBatch.from_arrays([pa.array([f"{place:019d}"]), pa.array([first], pa.int64()), pa.array([data], pa.binary())], ["place", "start", "block"])

        for batch in batches:
            for start, doc, n, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                apart = start != first + held
                if docs and (held >= block_ids or apart):
                    yield flush()
                    docs, counts, parts, held = [], [], [], 0
                if not docs:
                    first, place = start, start if apart or place is None else place
                docs.append(doc)
                counts.append(n)
                parts.append(raw)
                held += n
        if docs:
            yield flush()

    store = TokenStore(ids.sparkSession, new_folder(ids.sparkSession, "tokens"))
    code = ids.sparkSession.createDataFrame([("lengths", bytearray(np.asarray(lengths, np.uint8).tobytes()))], "code string, value binary")
    write_files(code, "value", "code", f"{store.folder}/code")
    write_files(rows.mapInArrow(run, BLOCK_SCHEMA).sortWithinPartitions("place", "start"), "block", "place", f"{store.folder}/blocks")
    return store


def file_blocks(content: bytes) -> Iterator[bytes]:
    """The blocks of one file; one that is cut or not followed by a line feed raises ValueError."""
    at = 0
    while at < len(content):
        end = at + block_size(content, at)
        if content[end : end + 1] != b"\n":
            raise ValueError(f"cut block at byte {at}")
        yield content[at:end]
        at = end + 1


def read_blocks(store: TokenStore, with_ids: bool = False) -> DataFrame:
    """Documents from the stored files: doc_id, start, n_tokens, ids_crc32, and ids if asked for. Damage fails the job."""
    header = bytes(read_files(store.spark, f"{store.folder}/code").first()["content"])[:-1]  # a byte per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(np.frombuffer(header, np.uint8))
        for batch in batches:
            for data in (block for content in batch.column(0) for block in file_blocks(content.as_py())):
                docs, counts, ids, start = decoder.block(data)
                upto = np.concatenate(([0], np.cumsum(counts)))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(start + upto[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return read_files(store.spark, f"{store.folder}/blocks").select("content").mapInArrow(run, schema)


def store_tokens(docs: DataFrame, path: str, end_id: int = 1, limit: int = 18) -> TokenStore:
    """Encode ``docs`` and write their ids as files in the shared folder.

    Null texts count as empty and keep the end id alone; rows with equal doc_id are each stored, by text; null doc_ids
    come first; an empty table gives a code and no block; other columns are ignored. Memory in a task is bounded by
    the longest text and one block.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    ids = token_ids(docs, path, end_id, vocabulary)
    blocks = write_blocks(ids, code_lengths(id_counts(ids, vocabulary), limit), vocabulary)
    discard(ids)
    return blocks
