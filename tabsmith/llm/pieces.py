"""SentencePiece BPE encoding by backtracking, and decoding.

The ids of a merge-type encoding are the only sequence of pieces whose every
adjacent pair is stable: merging the characters of the two pieces again gives
the same two pieces. So a text needs no merge queue. An Aho-Corasick automaton
gives all pieces that match at each position; the encoder takes the longest
one that is stable beside the piece before it, falls back to shorter ones, and
steps back when none is left. A position that failed once fails always, which
one bit per position remembers.

Three facts of the model keep the work local, all checked when it is loaded:
two characters that stand side by side in no piece are never merged across, so
a text is cut there; characters without a piece become byte pieces; and runs
of blanks, whose pieces all share the lowest score, merge from the left after
everything else.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabsmith.llm.common import c, slices, text_of

BLANK = "▁"
#: Words whose ids a Python worker keeps, and pairs of pieces that it knows to be stable or not.
CACHE_WORDS, CACHE_PAIRS = 500_000, 500_000

_models: dict[str, PieceModel] = {}


class PieceModel:
    """A BPE model of the sentencepiece library with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {i: lib.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: lib.get_score(i) for i, p in self.piece.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.byte):
            raise ValueError("the model has no byte fallback")
        many = [p for p in self.id if len(p) > 1]
        self.runs = {len(p) for p in many if not p.strip(BLANK)}
        words = [p for p in many if p.strip(BLANK)]
        if any(ch not in self.id for p in many for ch in p):
            raise ValueError("a piece holds a character that is no piece")
        if any(BLANK * 2 in p for p in words):
            raise ValueError("a piece joins a run of blanks with a word")
        if len({self.score[p] for p in words}) < len(words):
            raise ValueError("two pieces share a score")
        if self.runs and max(self.score[BLANK * k] for k in self.runs) >= min((self.score[p] for p in words), default=0):
            raise ValueError("a run of blanks merges before a word")
        if len({self.score[BLANK * k] for k in self.runs}) > 1:
            raise ValueError("runs of blanks differ in their score")
        self.beside = {p[i : i + 2] for p in words for i in range(len(p) - 1)}
        self.find = ahocorasick.Automaton()
        # A piece that its own merges do not make can be in no encoding.
        for p in [*words, *(p for p in self.id if len(p) == 1)]:
            if self.merge(p) == [p]:
                self.find.add_word(p, (len(p), self.id[p]))
        self.find.make_automaton()
        # Words with the blank before them; a blank never follows a character inside a piece.
        if any(b != a and b == BLANK for a, b in self.beside):
            raise ValueError("a piece holds a blank after another character")
        self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        # A line break without a piece parts what stands around it.
        self.breaks = b"" if any("\n" in p for p in self.id) else array("I", [self.byte[10]]).tobytes()
        self.known: dict[str, bytes] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.run_ids: dict[int, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def merge(self, s: str) -> list[str]:
        """Merge the characters of a short string: best score first, then leftmost."""
        parts = list(s)
        while len(parts) > 1:
            options = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pair(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        if len(self.stable) > CACHE_PAIRS:
            self.stable = {}
        both = [self.piece[a], self.piece[b]]
        ok = self.stable[a, b] = self.merge("".join(both)) == both
        return ok

    def backtrack(self, s: str) -> list[int]:
        """Ids of a string of known characters without runs of blanks."""
        n = len(s)
        options: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.find.iter(s):
            options[end + 1 - length].append((length, i))
        for each in options:
            if len(each) > 1:
                each.sort(reverse=True)
        failed, stable = bytearray(n // 8 + 1), self.stable
        out, taken, pos, k = [], [], 0, 0
        while pos < n:
            last, each = out[-1] if out else None, options[pos]
            while k < len(each):
                length, i = each[k]
                end = pos + length
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = last is None or stable.get((last, i))
                    if ok or ok is None and self.pair(last, i):
                        break
                k += 1
            if k < len(each):
                out.append(i)
                taken.append((pos, k))
                pos, k = end, 0
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos, k = taken.pop()
                out.pop()
                k += 1
        return out

    def blanks(self, n: int) -> list[int]:
        """Ids of a run of n blanks: pieces of one score, merged from the left."""
        if n not in self.run_ids:
            size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            queue = [(i, 1, 1) for i in range(n - 1) if 2 in self.runs]
            heapq.heapify(queue)
            while queue:
                i, a, b = heapq.heappop(queue)
                j = after[i]
                if size[i] != a or j >= n or size[j] != b:
                    continue
                size[i], size[j], after[i] = a + b, 0, after[j]
                if after[i] < n:
                    before[after[i]] = i
                    if size[i] + size[after[i]] in self.runs:
                        heapq.heappush(queue, (i, size[i], size[after[i]]))
                if before[i] >= 0 and size[before[i]] + size[i] in self.runs:
                    heapq.heappush(queue, (before[i], size[before[i]], size[i]))
            found = [self.id[BLANK * k] for k in size if k]
            if n > 1000:
                return found
            self.run_ids[n] = found
        return self.run_ids[n]

    def word(self, s: str) -> list[int]:
        """Ids of a string without runs of blanks, cut where no piece goes across."""
        out, start = [], 0
        for i in range(1, len(s) + 1):
            if i < len(s) and s[i - 1 : i + 1] in self.beside:
                continue
            part, start = s[start:i], i
            if len(part) > 1:
                out += self.stem(part)
            elif part in self.id:
                out.append(self.id[part])
            else:
                out += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        return out

    def stem(self, part: str) -> list[int]:
        """Ids of a string that no cut divides; kept for short ones that follow a blank."""
        if part[0] != BLANK or len(part) > 64:
            return self.backtrack(part)
        kept = self.known.get(part[1:])
        if kept is None:
            ids = self.backtrack(part)
            self.known[part[1:]] = array("I", ids).tobytes()
            return ids
        return array("I", kept).tolist()

    def chunk(self, s: str) -> list[int]:
        """Ids of a run of blanks, a word, or both."""
        body = s.lstrip(BLANK)
        run = len(s) - len(body)
        if not body:
            return self.blanks(run)
        if run < 2:
            return self.word(s)
        ids = self.word(BLANK + body)
        if ids[0] == self.id[BLANK]:
            return self.blanks(run) + ids[1:]
        return self.blanks(run - 1) + ids

    def line(self, s: str) -> list[bytes]:
        """Packed ids of a normalised line: word by word, or by chunks where blanks stand together."""
        first, *words = s.split(BLANK)
        if "" in words:
            return [array("I", self.chunk(part)).tobytes() for part in self.cut.findall(s)]
        known, long = self.known, {}
        for w in set(words).difference(known):
            packed = array("I", self.word(BLANK + w)).tobytes()
            (known if len(w) < 64 else long)[w] = packed
        out = [long[w] if w in long else known[w] for w in words] if long else [known[w] for w in words]
        return [array("I", self.word(first)).tobytes(), *out] if first else out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        lines = self.library.normalize(text).split("\n") if self.breaks else [self.library.normalize(text)]
        out = self.line(lines[0])
        for s in lines[1:]:
            out.append(self.breaks)
            out += self.line(s)
        return array("I", b"".join(out)).tolist()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(c(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; see `piece_digests` for nulls and the like."""
    return _mapped(docs, model, id_col, text_col, False)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    `ids_sha256` hashes the decimal ids joined by commas, `decoded_sha256` the
    text that the ids decode to. A null text is an empty one and has no ids.
    Ids of documents are carried along, null and repeated ones too. An empty
    table gives no rows; other columns are not read. Texts of any length are
    encoded in time linear in their length, but for stretches that step back.
    """
    return _mapped(docs, model, id_col, text_col, True)


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType)]
    if digests:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceModel.of(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches):
            ids = [coder.encode(t) for t in b.column("text").to_pylist()]
            texts = [coder.library.decode(x) for x in ids]
            if digests:
                made = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(str, x))) for x in ids], pa.string()), pa.array([sha(t) for t in texts], pa.string())]
            else:
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=[f.name for f in fields])

    return rows.mapInArrow(run, schema)
