"""Operator 6: SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

For a merge-type (BPE) vocabulary a text is encoded by merging, again and again, the adjacent pair of symbols whose
concatenation is the piece with the best score, the leftmost of equals first. The pairs wait in a heap ordered by
(-score, position). No piece of the vocabulary has a word mark after another symbol (runs of marks apart), so a text
may be cut before every mark that follows another symbol: the cuts are words, and a worker keeps the words it has met.
Every new word's ids are checked against the sentencepiece library in the Arrow slice that brings it, and the first
text of each slice is checked whole, ids and decoded text; a difference raises.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import arrow_map, texts

MARK = "▁"
#: Words (and stretches of words) a worker keeps in each of two generations; a word met again moves to the younger.
KEPT_WORDS = 300_000
#: Up to so many symbols the agenda is a plain list, searched for its least entry; beyond, a heap.
SHORT = 40
_LOADED: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder of one model file. ``check`` compares every word with the library."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        p = self.library
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.scores = [p.get_score(i) for i in range(n)]
        self.unk, self.bos, self.eos = p.unk_id(), p.bos_id(), p.eos_id()
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.cost = {self.pieces[i]: -self.scores[i] for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece holds a word mark after another symbol; words cannot be told apart")
        self.plain = {i: self.pieces[i].replace(MARK, " ").encode() for i in normal}
        self.plain |= {i: bytes([b]) for i, b in self.byte_of.items()} | {self.bos: b"", self.eos: b""}
        self.plain[self.unk] = " \u2047 ".encode()
        #: Neighbouring symbols that some piece holds; no merge reaches across any others, so a word is cut there.
        self.joined = {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.unchecked: dict[str, bytes] = {}
        self.cut = re.compile(rf"(?<=[^{MARK}])(?={MARK})")

    def agenda(self, symbols: str) -> list[int]:
        """Ids of a string of symbols (word marks in place): the score-ordered agenda."""
        if len(symbols) > SHORT:
            return self._heap(symbols)
        cost, none = self.cost.get, math.inf
        text = list(symbols)
        waiting = [cost(symbols[i : i + 2], none) for i in range(len(text) - 1)]
        while waiting and (best := min(waiting)) is not none:
            i = waiting.index(best)
            joined = text[i] = text[i] + text[i + 1]
            del text[i + 1], waiting[i]
            if i < len(waiting):
                waiting[i] = cost(joined + text[i + 1], none)
            if i:
                waiting[i - 1] = cost(text[i - 1] + joined, none)
        return self._ids(text)

    def _heap(self, symbols: str) -> list[int]:
        get, scores, push, pop = self.ids.get, self.scores, heapq.heappush, heapq.heappop
        text: list[str | None] = list(symbols)
        n = len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-scores[found], i, i + 1, joined) for i in range(n - 1) if (found := get(joined := symbols[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, right, joined = pop(heap)
            a, b = text[left], text[right]
            if a is None or b is None or len(a) + len(b) != len(joined) or after[left] != right:
                continue
            text[left], text[right] = joined, None
            nxt, prev = after[right], before[left]
            after[left] = nxt
            if nxt >= 0:
                before[nxt] = left
                if (found := get(new := joined + text[nxt])) is not None:
                    push(heap, (-scores[found], left, nxt, new))
            if prev >= 0 and (found := get(new := text[prev] + joined)) is not None:
                push(heap, (-scores[found], prev, left, new))
        return self._ids([x for x in text if x is not None])

    def _ids(self, text: list[str]) -> list[int]:
        out: list[int] = []
        for piece in text:
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unk)
        return out

    def word(self, symbols: str) -> bytes:
        """Packed ids of a word: the agenda of each stretch between symbols that no piece joins."""
        out, joined, start, n = b"", self.joined, 0, len(symbols)
        for end in range(1, n + 1):
            if end == n or symbols[end - 1 : end + 1] not in joined:
                part = symbols[start:end]
                if (got := self.parts.get(part)) is None:
                    if (got := self.old_parts.get(part)) is None:
                        ids = self.agenda(part)
                        got = struct.pack(f"<{len(ids)}I", *ids)
                    if len(self.parts) >= KEPT_WORDS:
                        self.old_parts, self.parts = self.parts, {}
                    self.parts[part] = got
                out += got
                start = end
        return out

    def new(self, plain: str) -> bytes:
        """Packed ids of a word that comes after a space (or first), kept for the next time."""
        if (got := self.old_words.get(plain)) is None:
            got = self.word(MARK + plain)
            if self.check and plain:
                self.unchecked[plain] = got
        if len(self.words) >= KEPT_WORDS:
            self.old_words, self.words = self.words, {}
        self.words[plain] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids with begin and end ids, as little-endian unsigned 32-bit integers. An empty text has these two alone."""
        body = b""
        if text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            known, new = self.words.get, self.new
            body = b"".join([known(w) or new(w) for w in text.split(" ")])
        elif text:
            body = b"".join([self.word(w) for w in self.cut.split(MARK + text.replace(" ", MARK))])
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos)

    def decode(self, packed: bytes) -> str:
        """The library's decode(ids): pieces joined, marks as spaces, one leading space dropped, bytes as UTF-8."""
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        joined = b"".join(map(self.plain.__getitem__, ids))
        try:
            return (joined[1:] if joined[:1] == b" " else joined).decode()
        except UnicodeDecodeError:  # byte pieces that are no text: the library has its own rule
            return self.library.decode(list(ids))

    def settle(self, texts: list[str], packed: list[bytes], decoded: list[str]) -> None:
        """Compare the words met since the last call, and the first text whole, with the library."""
        if not self.check:
            return
        words = list(self.unchecked)
        for w, ids in zip(words, self.library.encode(words, num_threads=1) if words else [], strict=True):
            if struct.pack(f"<{len(ids)}I", *ids) != self.unchecked[w]:
                raise ValueError(f"the library encodes {w!r} as {ids}")
        self.unchecked.clear()
        if texts:
            ids = self.library.encode(texts[0], add_bos=True, add_eos=True, num_threads=1)
            if struct.pack(f"<{len(ids)}I", *ids) != packed[0] or self.library.decode(ids) != decoded[0]:
                raise ValueError(f"the library differs on the text that begins {texts[0][:80]!r}")


def load(path: str) -> PieceCodec:
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as array<int>).

    Whole texts; null is taken as empty: begin and end ids only, decoded as the empty text. Equal or repeated rows get
    equal rows, an empty table none. Rows of null ids are encoded like others, other columns not read. ``model_path`` must exist on every executor, as an installed package's file does.
    """
    extra = ", ids array<int>" if keep_ids else ""

    def make(part: pa.RecordBatch) -> dict:
        codec: PieceCodec = load(model_path)
        whole = part.column("text").to_pylist()
        packed = [codec.encode(t) for t in whole]
        decoded = [codec.decode(x) for x in packed]
        codec.settle(whole, packed, decoded)
        out = {
            "doc_id": part.column("doc_id"),
            "n_tokens": [len(x) // 4 for x in packed],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }
        if keep_ids:
            out["ids"] = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in packed]
        return out

    return arrow_map(texts(df, id_col, text_col), make, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
