"""Operator 12, SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

A sequence of pieces is what merging gives if and only if each two neighbours are what merging gives for their own letters. So a
text is walked with the longest piece at each place (one pass of an Aho-Corasick automaton gives all of them); a piece stays if
merging it anew with the piece before it leaves both as they are, else the next shorter one is tried; a place from which nothing
fits is marked in a bitfield and never tried again. Time grows with the text's length, even without any space in it.

No merge joins two characters that stand side by side in no piece, so texts may be cut there: before spaces,
where no piece has a space after another character, and around characters in no piece. What a stretch between cuts encodes to is kept for the next
time, for a bounded number of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import STRING, extended, kept, map_arrow

SPACE = "▁"
KEPT_STRETCHES, KEPT_LETTERS = 1 << 18, 64
KEPT_PAIRS = 1 << 20
IDS_AT_ONCE = 1 << 20


class Merges:
    """The pieces of a model and what merging does with them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(m.is_byte, self.bytes)):
            raise ValueError("the model has no byte pieces")
        if any(self.score[p] >= 0 for p in self.id):
            raise ValueError("the model has pieces that users defined, which are not merged")
        made = [p for p in self.id if len(p) > 1 and self.merged(p) == [p]]  # merging never reaches the others
        for p in made:
            if len(set(p)) > 1 and any(len(x) > 1 and self.score[x] <= self.score[p] for x in self.merged(p, stop=2)):
                raise ValueError(f"piece {p!r} is merged before its parts")
        letters = set("".join(self.id))
        self.letters = letters
        tokens = sorted(letters | set(made))
        self.piece, self.length = tokens, [len(t) for t in tokens]
        known = {t: k for k, t in enumerate(tokens)}
        self.shorter = [next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1) for t in tokens]
        self.ids = [(self.id[t],) if t in self.id else self.as_bytes(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for t, k in known.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        alone = not any(SPACE in p.lstrip(SPACE) for p in made)
        apart = "".join(c for c in "\t\n\x0b\x0c\r" if c not in letters)
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+|[{apart}]+" if alone and apart else "(?s:.+)")
        known_class = "".join(map(re.escape, sorted(letters)))
        self.apart = re.compile(f"([{known_class}]+)|([^{known_class}]+)")
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def as_bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in text.encode("utf-8", "surrogatepass"))

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The parts of a short text after merging the best pair, the leftmost of equals, until none or `stop` parts are left."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the letters of two pieces anew gives the two."""
        p, q = self.piece[a], self.piece[b]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[a * len(self.piece) + b] = self.merged(p + q) == [p, q]
        return found

    def walk(self, text: str) -> list[int]:
        """The pieces of a text whose characters all occur in pieces."""
        n, length, shorter, pairs, many = len(text), self.length, self.shorter, self.pairs, len(self.piece)
        longest = [-1] * n
        for end, t in self.automaton.iter(text):
            longest[end + 1 - length[t]] = t  # a later end is a longer piece
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, last, t = 0, -1, longest[0] if n else -1
        while at < n:
            while t >= 0:
                end = at + length[t]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last * many + t)
                    if self.fit(last, t) if fits is None else fits:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at, last = end, t
                t = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                t = out.pop()
                at -= length[t]
                last = out[-1] if out else -1
                t = shorter[t]
        return out

    def _stretch(self, text: str) -> tuple[int, ...]:
        own = self.ids
        if self.letters.issuperset(text):
            return tuple(i for t in self.walk(text) for i in own[t])
        ids: list[int] = []
        for known, other in self.apart.findall(text):
            if known:
                for t in self.walk(known):
                    ids += own[t]
            else:
                ids += self.as_bytes(other)
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text, normalised as the model says."""
        kept, out = self.kept, []
        for s in self.stretch.findall(self.model.normalize(text or "")):
            ids = kept.get(s)
            if ids is None:
                ids = self.before.get(s) or self._stretch(s)
                if len(s) <= KEPT_LETTERS:
                    if len(kept) >= KEPT_STRETCHES:  # what is asked for again comes back from the older half
                        self.before, self.kept = kept, {}
                        kept = self.kept
                    kept[s] = ids
            out += ids
        return out


def merges(path: str) -> Merges:
    """One per worker process, kept from task to task."""
    return kept(__name__, path, lambda: Merges(path))


def encoded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids (without begin or end) and the text that they decode to.

    The model must be of the merge type, with byte pieces, and at this path on every executor; other models raise an error. A
    null or empty text has no ids and decodes to an empty text; repeated rows are treated each; an empty table gives an
    empty result. A batch of rows leaves as soon as its ids are 2^20.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(model_path)
        for b in batches:
            a, ids, ends, texts = 0, [], [0], []
            for k, t in enumerate(b[text_col]):
                own = m.encode(t.as_py())
                ids.append(np.array(own, dtype=np.int32))
                ends.append(ends[-1] + len(own))
                texts.append(m.model.decode(own) if own else "")
                if ends[-1] >= IDS_AT_ONCE or k == b.num_rows - 1:
                    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([b[id_col].slice(a, len(texts)), values, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])
                    a, ids, ends, texts = k + 1, [], [0], []

    picked = docs.select(id_col, text_col)
    return map_arrow(picked, run, extended(picked.select(id_col).schema, ids=T.ArrayType(T.IntegerType()), decoded=STRING))


def id_digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per row of encoded(): the number of ids and digests of them and of the decoded text."""
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


__all__ = ["Merges", "encoded", "id_digests", "merges"]
