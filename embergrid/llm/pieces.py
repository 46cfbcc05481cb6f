"""SentencePiece BPE encoding by backtracking, and decoding.

A text's encoding is the one sequence of pieces whose neighbours are all compatible: merging the characters of two neighbours
again, best score and then leftmost first, gives these two. (What merges across a border in the whole text would merge across it in
the pair alone, as the merges on both sides come in the same order.) So an encoding is found without merging the text:
an Aho-Corasick automaton gives the longest piece that starts at each character; the next piece is the longest one compatible
with the last, else its next shorter prefix that is a piece, else the last piece is taken back; a position taken back is marked in a bitfield and
never tried again, so the work stays in proportion to the text. Characters that are no piece become their UTF-8 bytes' pieces.

Texts are cut between two bytes that no piece holds side by side, where no merge can reach; a distinct chunk is encoded once per
Python worker (``tokens.ChunkMemo``, at most ``max_entries`` of up to 64 bytes, some 80 MB). Compatible pairs are remembered, too, at most 2^19.

``encode`` gives the ids of whole texts with an end id; ``decode`` the text of ids; ``digests`` what can be compared.

Cases: null and empty texts have the end id only and decode to an empty text; texts of any length, without spaces too, are encoded whole, in
linear time; each row is encoded on its own, so null and repeated ids and equal texts are kept as they are; an empty table gives no rows; other columns are
ignored. Bytes that are no UTF-8 are read as U+FFFD. Models of another kind (no BPE, no byte fallback, with a normaliser) are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, as_bytes, small_batches, tidy
from .tokens import ChunkMemo, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space in pieces
PAIRS = 1 << 19


class PieceModel:
    """The model's tables, and the encoding of one string."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm, piece = model.trainer_spec, model.normalizer_spec, model.SentencePiece
        if kind.model_type != kind.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError(f"{path}: only BPE with byte fallback, a space before the text and no other normalisation is supported")
        if any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == piece.NORMAL}
        self.score = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == piece.BYTE}
        self.end = kind.eos_id
        self.length = [len(t) for t in self.text]
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) if t in self.ids else -1 for t in self.text]
        self.longest = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.longest.add_word(t, (len(t), i))
        self.longest.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, tuple | None] = {}

    def name(self, token: int) -> str:
        return self.text[token] if token >= 0 else chr(~token)

    def merged(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """How the characters of a token merge, best score and then leftmost first: what each merge costs, and the first and the last part before
        it and at the end. None if they don't come to be the token."""
        parts, cost, left, right = list(self.name(token)), [], [], []
        while True:
            left.append(parts[0])
            right.append(parts[-1])
            found = [(-self.score[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return (cost + [inf], left, right) if len(parts) == 1 else None
            c, k = min(found)
            cost.append(c)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def run(self, token: int):
        if token not in self.runs:
            if len(self.runs) >= PAIRS:  # characters that are no piece
                self.runs.clear()
            self.runs[token] = self.merged(token)
        return self.runs[token]

    def fits(self, last: int | None, token: int) -> bool:
        """Whether token may follow last (None: begin a text)."""
        if last is None:
            return self.run(token) is not None
        key = (last << 22) + token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(self.run(last), self.run(token))
        return known

    def _stay_apart(self, a, b) -> bool:
        """Merge two neighbours again, side by side: does nothing merge across their border?"""
        if a is None or b is None:
            return False
        i = k = 0
        while True:
            across = self.ids.get(a[2][i] + b[1][k])
            if across is not None and -self.score[across] < a[0][i] and -self.score[across] <= b[0][k]:
                return False
            if a[0][i] == b[0][k] == inf:
                return True
            if a[0][i] <= b[0][k]:
                i += 1
            else:
                k += 1

    def encode(self, text: str) -> list[int]:
        """Pieces of a string in which spaces are marked; a character c that is no piece is ~ord(c)."""
        longest = [~ord(c) for c in text]
        for end, (n, i) in self.longest.iter(text):
            longest[end - n + 1] = i  # of the pieces that start at one place, the longest ends last
        failed, out, at, last = bytearray(len(text) // 8 + 1), [], 0, None
        token = longest[0] if text else None
        while at < len(text):
            end = at + (self.length[token] if token >= 0 else 1)
            if not failed[end >> 3] >> (end & 7) & 1 and self.fits(last, token):
                out.append(token)
                at, last = end, token
                token = longest[at] if at < len(text) else None
                continue
            token = self.shorter[token] if token >= 0 else -1
            while token == -1:  # nothing fits here: take the last piece back
                failed[at >> 3] |= 1 << (at & 7)
                back = out.pop()
                at -= self.length[back] if back >= 0 else 1
                last = out[-1] if out else None
                token = self.shorter[back] if back >= 0 else -1
        return out


class PieceTokenizer(ChunkMemo):
    def __init__(self, path: str, max_entries: int = 1 << 20):
        super().__init__(max_entries)
        self.path, self.model = path, PieceModel(path)
        beside = np.zeros((256, 256), bool)
        for t in self.model.ids:
            for b in {t.encode(), t.replace(MARK, " ").encode()}:
                beside[list(b[:-1]), list(b[1:])] = True
        if any(MARK * 2 in t for t in self.model.ids):
            beside[32, MARK.encode()[0]] = beside[MARK.encode()[-1], 32] = True
        beside[:, 0x80:0xC0] = True  # never inside a character
        self.apart = ~beside
        normal = set(self.model.ids.values())
        names = [b"" if i not in normal else t.replace(MARK, " ").encode() for i, t in enumerate(self.model.text)]
        for b, i in self.model.bytes.items():
            names[i] = bytes([b])
        self.names, self.digits = Strings(names), Strings([b"%d " % i for i in range(len(names))])
        #: Ids whose text is not simply their bytes: the library decodes rows that hold others than the end id.
        self.plain = np.array([len(n) > 0 for n in names])
        self.plain[self.model.end] = True
        self.marked = np.array([i in normal and t.startswith(MARK) for i, t in enumerate(self.model.text)])
        self.library = None

    def starts(self, raw: np.ndarray, first: np.ndarray, stop: np.ndarray, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(raw), bool)
        out[1:] = self.apart[raw[:-1], raw[1:]]
        return out

    def chunk_ids(self, chunks: list[bytes]) -> list[list[int]]:
        return [[x for i in self.model.encode(c.decode("utf-8", "replace").replace(" ", MARK)) for x in ([i] if i >= 0 else [self.model.bytes[b] for b in chr(~i).encode()])] for c in chunks]

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of the texts one after the other, each with the end id; and how many each has."""
        return self.encode_many([b" " + t if t else t for t in texts], self.model.end)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of ids, as decode(ids) of the library gives them."""
        raw, ends = self.names.joined(ids, counts)
        out, stops = [], np.cumsum(counts)
        odd = np.diff(np.concatenate([[0], np.cumsum(~self.plain[ids])])[np.concatenate([[0], stops])]) > 0
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            one, own = raw[a:b].tobytes(), ids[stops[k] - counts[k] : stops[k]]
            if odd[k] or not _is_text(one):
                if self.library is None:
                    from sentencepiece import SentencePieceProcessor

                    self.library = SentencePieceProcessor(model_file=self.path)
                out.append(self.library.decode(own.tolist()).encode())
            else:  # of the space before the text, which the first piece brings
                out.append(one[1:] if len(own) and self.marked[own[0]] else one)
        return out


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


class Strings:
    """A string for each id, and their joins for many ids at a time."""

    def __init__(self, values: list[bytes]):
        self.size = np.fromiter(map(len, values), np.int64, len(values))
        self.at, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(values) + b"\0", np.uint8)

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids' strings, and where the bytes of each row of `counts` ids end."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.at[ids] - ends[:-1], size)
        where += np.arange(ends[-1])
        return self.flat[where], ends[np.cumsum(counts)]


PIECES: dict[str, PieceTokenizer] = {}
CACHES.append(PIECES)


def tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker."""
    if path not in PIECES:
        PIECES[path] = PieceTokenizer(path)
    return PIECES[path]


STEP = 1 << 18  # ids that are decoded or rendered at a time, and one row more


def slices(counts: np.ndarray) -> Iterator[slice]:
    """Rows so that their counts add up to STEP or little more."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)) + 1
        yield slice(a, b)
        a = b


@partial(tidy, cache=PIECES)
def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(path)
    for b in batches:
        ids, counts = tok.encode_texts(b.column(1).to_pylist())
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))], names=["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids: of every whole text, with the end id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    return rows.mapInArrow(partial(_encode, path=path or tokenizer_path(MODEL)), "doc_id bigint, ids array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and counts of a list column; null lists and null ids count as absent."""
    at, flat = column.offsets.to_numpy(), column.values
    if column.null_count or flat.null_count:
        column = pa.array([[i for i in x or [] if i is not None] for x in column.to_pylist()], pa.list_(pa.int32()))
        at, flat = column.offsets.to_numpy(), column.values
    return flat.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at).astype(np.int64)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(path)
    for b in batches:
        ids, counts = _lists(b.column(1))
        stops, texts, hashes = np.cumsum(counts), [], []
        for s in slices(counts):
            own = ids[stops[s.start] - counts[s.start] : stops[min(s.stop, len(counts)) - 1]]
            texts += tok.decode(own, counts[s])
            if digest:
                raw, ends = tok.digits.joined(own, counts[s])
                hashes += [hashlib.sha256(raw[x : max(x, y - 1)]).hexdigest() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        if digest:
            yield pa.record_batch([b.column(0), pa.array(counts), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            yield pa.record_batch([b.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids)."""
    small_batches(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(tidy(partial(_decoded, path=path or tokenizer_path(MODEL), digest=False), PIECES), "doc_id bigint, text string")


def digests(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded text, of rows of (doc_id, ids)."""
    small_batches(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(tidy(partial(_decoded, path=path or tokenizer_path(MODEL), digest=True), PIECES), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
