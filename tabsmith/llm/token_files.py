"""Token ids as compressed binary blocks with random access to single documents.

Every text is encoded with a public tokenizer, one end id is appended, and the
ids are laid out as little-endian integers. Documents are compressed one by one
with Zstandard and a shared dictionary, trained on the id arrays of a bounded
sample of short documents, so that short documents compress well alone.

The file format is a folder of three Parquet tables, written and read by Spark
alone so that any store works:
  dictionary  one row: dict_hash (SHA-256), dictionary, width (bytes of an id)
  blocks      rows of (part, block, low, high, doc_ids, n_ids, offsets, payload,
              dict_hash): up to BLOCK_DOCS frames side by side, document i at
              payload[offsets[i]:offsets[i + 1]]
  starts      one row per (part, block): the number of ids before the block
Blocks follow ascending doc_id; a reader that wants one document finds its
block by low and high and decompresses that document's frame only.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tabsmith.llm.common import c, slices, text_of
from tabsmith.session import materialise

#: Most documents, and about the most compressed bytes, of a block.
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: The dictionary: its size, the most sampled documents, and the longest sampled text.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 64 << 10, 1000, 8000
#: Words of one generation of a worker's cache, the longest one kept, and how many are encoded at a time.
GENERATION, LONGEST, JOINED = 400_000, 100, 2000

# How a tokenizer file says that it lowers texts, drops white space and parts words from marks.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Pieces that can be parted here as the tokenizer parts them: Latin letters, digits, marks. Python takes four
#: separators (1C to 1F) for white space that the tokenizer takes for marks.
LATIN = re.compile("[\x21-\u012f\u0131-\u024f\u2010-\u2027]+")
RUNS = re.compile("'[sStT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[^\\W\\d_]+|[0-9]|(?:[^\\w\\s]|[_\x1c-\x1f])+|.")

_coders: dict[tuple, WordCoder] = {}


class WordCoder:
    """Ids of whole texts, looked up by word.

    The tokenizer drops white space and no token crosses it, so a text's ids
    are those of its pieces between blanks and line breaks. Inside a piece it
    parts letters, digits and marks; Latin pieces are parted alike, those of
    ASCII in one go, and each distinct part is encoded by the library once
    while it stays in the cache.
    Words of letters are encoded many at a time, parted by blanks, and cut
    behind the ids that end a word. All this is checked when the file is read.
    """

    def __init__(self, model: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.dtype = f"<u{width}"
        spec = json.loads(self.tokenizer.to_str())
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.mark = spec["model"].get("end_of_word_suffix")
        if (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS or not splits or splits[0].get("pattern") != {"Regex": SPLITTER}:
            raise ValueError("the tokenizer does not part and lower words in the known way")
        if spec["model"]["type"] != "BPE" or not self.mark or spec["model"].get("ignore_merges") or spec["truncation"] or spec["padding"]:
            raise ValueError("the tokenizer does not mark the end of a word")
        if any(ch in t["content"] for t in spec["added_tokens"] for ch in " \n"):
            raise ValueError("a special token goes across a cut")
        #: Strings that the tokenizer takes whole, wherever they stand.
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)", re.IGNORECASE)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 8 * width:
            raise ValueError(f"ids do not fit in {width} bytes")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.mark)]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, model: str, width: int) -> WordCoder:
        if (model, width) not in _coders:
            _coders[model, width] = cls(model, width)
        return _coders[model, width]

    def _parts(self, piece: str) -> list[str]:
        """What the tokenizer parts a piece that is not all ASCII into, or the piece itself where other scripts or special strings would decide."""
        if not self.special.search(piece) and LATIN.fullmatch(piece) and unicodedata.is_normalized("NFC", piece):
            return RUNS.findall(piece)
        return [piece]

    def _each(self, words: list[str]) -> dict[str, bytes]:
        """Ids of strings, each encoded alone."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, dtype=self.dtype).tobytes() for w, e in zip(words, found)}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, encoded together; where the ends do not tell the words apart, each alone."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: dict[str, bytes] = {}
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(ends) != len(group) or ends[-1] != ids.nbytes:
                out.update(self._each(group))
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            out.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _new(self, parts: set[str]) -> None:
        """Bring ids of strings into the cache, from the older generation or the library."""
        young, old, letters, others = self.young, self.old, [], []
        for x in parts:
            if x not in young:
                ids = old.get(x)
                if ids is not None:
                    young[x] = ids
                else:
                    (letters if x.isalpha() else others).append(x)
        young.update(self._letters(letters))
        young.update(self._each(others))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, from the cache or the library."""
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        words, mixed, rest = [], [], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = pieces[i]
            ids = old.get(p)
            if ids is not None:
                out[i] = young[p] = ids
            elif p.isascii():
                (words if p.isalpha() else mixed).append(i)
            else:
                rest.append(i)
        # Pieces are lowered and parted together, parted by blanks, which no piece holds.
        if self.special.search(" ".join([pieces[i] for i in mixed])):
            rest += [i for i in mixed if self.special.search(pieces[i])]
            mixed = [i for i in mixed if not self.special.search(pieces[i])]
        lower = " ".join([pieces[i] for i in words]).lower().split(" ")
        flat = RUNS.findall(" ".join([pieces[i] for i in mixed]).lower())
        parts = [self._parts(pieces[i]) for i in rest]
        needed = set(lower).union(flat, *parts) - {" "}
        self._new(needed)
        for i, word in zip(words, lower):
            out[i] = young[word]
        young[" "] = b""
        start, known = 0, [young[x] for x in flat]
        for i, end in zip(mixed, [*(k for k, x in enumerate(flat) if x == " "), len(flat)]):
            out[i] = b"".join(known[start:end])
            start = end + 1
        for i, own in zip(rest, parts):
            out[i] = b"".join([young[x] for x in own])
        for i in [*words, *mixed, *rest]:
            if len(pieces[i]) <= LONGEST:
                young[pieces[i]] = out[i]
        for x in needed:
            if len(x) > LONGEST:
                del young[x]
        if len(young) > GENERATION:
            # What was not asked for during a whole generation is forgotten.
            self.young, self.old = {"": b""}, young
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: a piece is looked up once for all texts given, its ids are copied to all its places."""
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        split = pc.split_pattern(lines, " ")
        coded = split.values.dictionary_encode()
        ids = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), self.dtype)
        # Small batches have small positions. A byte gives at most three ids.
        kind = np.int32 if lines.nbytes < 1 << 29 else np.int64
        size = np.fromiter(map(len, ids), kind, len(ids)) // flat.itemsize
        first = np.cumsum(size, dtype=kind) - size
        at = coded.indices.to_numpy()
        ends = np.concatenate([np.zeros(1, kind), np.cumsum(size[at], dtype=kind)])
        # Place i of the output is as far into its piece as it is behind the piece's first place.
        places = np.arange(ends[-1], dtype=kind) + np.repeat(first[at] - ends[:-1], size[at])
        out, bounds = flat[places], ends[split.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _batches(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train_dictionary(docs: DataFrame, model: str, end_id: int, width: int, id_col: str, text_col: str) -> bytes:
    """A Zstandard dictionary, or no bytes where the sample is too small to train one.

    The sample are up to SAMPLE_DOCS texts of at most SAMPLE_CHARS characters,
    picked by hash: bounded, and the same on a rerun. About as many are sorted.
    """
    text, share = text_of(text_col), max(1, docs.count() // SAMPLE_DOCS)
    picked = docs.select(text.alias("text"), F.xxhash64(c(id_col), text).alias("h")).filter(F.pmod("h", F.lit(share)) == 0)
    sample = picked.filter(F.length("text").between(1, SAMPLE_CHARS)).orderBy("h", "text").limit(SAMPLE_DOCS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordCoder.of(model, width), np.array([end_id], f"<u{width}").tobytes()
        for b in batches:
            yield pa.record_batch([pa.array([x + end for x in coder.encode(b.column(0).to_pylist())], pa.binary())], ["ids"])

    rows = [bytes(r["ids"]) for r in sample.select("text").mapInArrow(encoded, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(rows)).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_ids(
    docs: DataFrame,
    path: str,
    model: str,
    end_id: int = 1,
    width: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write the ids below `path`, in ascending id order.

    A null text is an empty one: its only id is `end_id`. Null ids come last;
    rows of the same id follow the order of their text's hash and repeated rows
    are all kept. `width` is the bytes of an id, enough for the vocabulary. An
    empty table gives empty tables. Other columns are not read.
    """
    dictionary = train_dictionary(docs, model, end_id, width, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    id_type = docs.schema[id_col].dataType
    spark = docs.sparkSession
    kept = T.StructType([T.StructField("dict_hash", T.StringType()), T.StructField("dictionary", T.BinaryType()), T.StructField("width", T.IntegerType())])
    spark.createDataFrame([(digest, bytearray(dictionary), width)], kept).write.parquet(f"{path}/dictionary")
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (
            ("part", T.IntegerType()), ("block", T.IntegerType()), ("low", id_type), ("high", id_type),
            ("doc_ids", T.ArrayType(id_type)), ("n_ids", T.ArrayType(T.LongType())), ("offsets", T.ArrayType(T.LongType())),
            ("payload", T.BinaryType()), ("dict_hash", T.StringType()), ("ids", T.LongType()),
        )]
    )
    rows = docs.select(c(id_col).alias("id"), text_of(text_col).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordCoder.of(model, width), np.array([end_id], f"<u{width}").tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)
        ids, counts, frames, size, number, part = [], [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)])
            present = [x for x in ids if x is not None]
            row = [part, number, present[0] if present else None, present[-1] if present else None, ids, counts, offsets.tolist(), b"".join(frames), digest, sum(counts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        arrow = _arrow(schema)
        for b in slices(batches, 1000):
            texts = b.column("text").to_pylist()
            keys, part = b.column("id").to_pylist(), b.column("part")[0].as_py() if len(texts) else part
            for lo, hi in _batches(texts):
                for key, raw in zip(keys[lo:hi], coder.encode(texts[lo:hi])):
                    ids.append(key)
                    counts.append(len(raw) // width + 1)
                    frames.append(press.compress(raw + end))
                    size += len(frames[-1])
                    if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield block()
                        ids, counts, frames, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    ranged.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")
    # Parts ascend with the ids. Their totals are one row each, their blocks a few rows each.
    held = materialise(spark.read.parquet(f"{path}/blocks").select("part", "block", "ids"), "block-counts")
    parts = held.groupBy("part").agg(F.sum("ids").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    local = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("part", "block", F.coalesce(F.sum("ids").over(local), F.lit(0)).alias("inner")).join(offsets, "part")
    starts.select("part", "block", (F.col("offset") + F.col("inner")).alias("start")).write.parquet(f"{path}/starts")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_ids(spark: SparkSession, path: str, ids: list | None = None, digests_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): one row per document of the files.

    `start` counts the ids of all documents before it, `ids_crc32` is the
    unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    `ids` asks for some documents by id: only blocks whose range holds one are
    read, and only those documents are decompressed. `digests_only` leaves the
    column `ids` out. A block of another dictionary is an error.
    """
    known = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, digest, width = bytes(known["dictionary"]), known["dict_hash"], known["width"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary in {path} does not have its hash")
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["low"].dataType
    if ids is not None:
        hit = F.lit(False)
        for i in ids:
            hit = hit | ((F.col("low") <= F.lit(i)) & (F.col("high") >= F.lit(i)))
        blocks = blocks.filter(hit)
    rows = blocks.join(spark.read.parquet(f"{path}/starts"), ["part", "block"]).select(
        "start", "doc_ids", "n_ids", "offsets", "payload", "dict_hash"
    )
    fields = [("doc_id", id_type), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [] if digests_only else [("ids", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    wanted = None if ids is None else set(ids)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("the block was written with another dictionary")
                out, start, payload, offsets = [], row["start"], memoryview(row["payload"]), row["offsets"]
                for i, (key, n) in enumerate(zip(row["doc_ids"], row["n_ids"])):
                    if wanted is None or key in wanted:
                        raw = np.frombuffer(unpack.decompress(payload[offsets[i] : offsets[i + 1]]), f"<u{width}")
                        if len(raw) != n:
                            raise ValueError(f"document {key} has {len(raw)} ids, not {n}")
                        crc = zlib.crc32(raw.astype("<u4").tobytes())
                        out.append((key, start, n, crc) if digests_only else (key, start, n, crc, raw.tolist()))
                    start += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(documents, schema)
