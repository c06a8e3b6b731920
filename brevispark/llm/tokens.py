"""Byte-level BPE ids of whole texts through the tokenizers library, quickly.

The vocabulary's pre-tokeniser always starts a piece at a space before a non-space, so a text is cut there and a piece's
ids do not depend on what stands around it. Pieces are encoded once per worker and remembered in tables that are bounded in
number and in bytes; long ones (texts without spaces, say) are encoded each time.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

from brevispark.llm.common import settle

#: Pieces that a worker remembers: about 0.2 GB a million. More save CPU seconds.
MOST_PIECES = 300_000
#: Bytes that a remembered piece may take on average (the tables are emptied beyond that), and the longest remembered one.
PIECE_BYTES, LONGEST = 400, 256
_BREAKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_MARKS = ".,;:!?%$#&*"
_CUT = re.compile(r" (?=\S)")
_encoders: dict[tuple[str, int], "Encoder"] = {}


def _pieces(text: str) -> list[str]:
    """text cut at each space before a non-space; a plain split does for most texts in ASCII."""
    if text.isascii() and " \n" not in text and not any(c in text for c in _BREAKS):
        out = text.split(" ")
        if "" not in out[1:]:
            return out
    return _CUT.split(text)


class Pieces(dict):
    """Pieces and their ids, bounded in number and in bytes."""

    def __init__(self, most: int):
        self.most, self.held = most, 0

    def add(self, pieces: list[tuple[str, bytes]]) -> None:
        self.update(pieces)
        self.held += 200 * len(pieces) + sum(map(len, [x for pair in pieces for x in pair]))

    def shrink(self) -> None:
        """Starts anew if it holds too much."""
        if len(self) > self.most or self.held > PIECE_BYTES * self.most:
            self.clear()
            self.held = 0


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, without special tokens; their strings in a text are ordinary text."""

    def __init__(self, path: str, most_pieces: int = MOST_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.size = self.t.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(self.size, bool)
        for token, i in self.t.get_vocab(with_added_tokens=False).items():
            self.opens[i] = token[0] == "Ġ"
        self.line_ids = self._ids(["\n"])[0].tobytes()
        self.line = int.from_bytes(self.line_ids, "little")
        self.known, self.heads = Pieces(most_pieces), Pieces(most_pieces // 8)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], mark: str, edges, known: Pieces) -> None:
        """Remembers the ids of words without white space, encoded together with mark between them.

        edges(ids) finds where each begins and ends.
        """
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            raw = self._ids([mark + mark.join(part) + mark])[0]
            starts, ends = edges(raw)
            if len(starts) == len(part):
                ids = raw.tobytes()
                known.add([(w, ids[4 * a : 4 * b]) for w, a, b in zip(part, starts.tolist(), ends.tolist())])
            else:
                known.add([(w, x.tobytes()) for w, x in zip(part, self._ids([mark.strip("\n") + w for w in part]))])

    def _learn_heads(self, words: set[str]) -> None:
        """Words that no space precedes: between line breaks, each of which is one token."""

        def edges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(ids == self.line)
            return at[:-1] + 1, at[1:]

        self._joined([w for w in words if w not in self.heads], "\n", edges, self.heads)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of ' ' + piece.

        Stems are remembered, and so are pieces of a stem known before (a new one will hardly come again). A piece is put
        together from its lines, and these from a stem and the marks behind it, as far as the pre-tokeniser always cuts
        there.
        """
        marked, made, other, spaced, heads = [], [], [], set(), set()
        for p in pieces:
            if len(p) > LONGEST:
                other.append(p)
                continue
            if p.isalnum():
                spaced.add(p)
                continue
            stem = p.rstrip(_MARKS)
            if stem.isalnum():
                spaced.add(stem)
                marked.append((p, stem, p[len(stem) :]))
                continue
            lines = p.split("\n")
            if p.split() != lines:
                other.append(p)
                continue
            parts = []
            for k, line in enumerate(lines):
                stem = line.rstrip(_MARKS)
                if not stem or not stem[-1].isalnum():
                    stem = line
                (heads if k else spaced).add(stem)
                if len(stem) < len(line):
                    heads.add(line[len(stem) :])
                parts.append((stem, line[len(stem) :]))
            if len(parts) > 1 or parts[0][1]:
                made.append((p, parts))

        def edges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(self.opens[ids])  # the last is the space at the end
            return at[:-1], at[1:]

        known, at_start = self.known, self.heads
        again = {p for p, stem, _ in marked if stem in known}
        self._joined([w for w in spaced if w not in known], " ", edges, known)
        self._learn_heads(heads.union(m for *_, m in marked))
        out = {p: known[stem] + at_start[marks] for p, stem, marks in marked}
        known.add([(p, out[p]) for p in again])
        for p, parts in made:
            out[p] = self.line_ids.join(
                (at_start if k else known)[stem] + (at_start[marks] if marks else b"")
                for k, (stem, marks) in enumerate(parts)
            )
        out.update((p, x.tobytes()) for p, x in zip(other, self._ids([" " + p for p in other])))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk the table of pieces
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            cut = [_pieces(x) if x else [""] for x in texts[at : at + 256]]
            self.known.shrink()
            self.heads.shrink()
            first = [pieces.pop(0) for pieces in cut]
            got = [list(map(self.known.get, pieces)) for pieces in cut]
            gaps = [
                (pieces, ids, [i for i, x in enumerate(ids) if not x]) for pieces, ids in zip(cut, got) if not all(ids)
            ]
            fresh = self._learn({pieces[i] for pieces, _, where in gaps for i in where}) if gaps else {}
            for pieces, ids, where in gaps:
                for i in where:
                    p = pieces[i]
                    ids[i] = fresh[p] if p in fresh else self.known[p]
            heads = sorted({h for h in first if h not in self.heads})
            own = dict(zip(heads, [x.tobytes() for x in self._ids(heads)]))
            self.heads.add([(h, x) for h, x in own.items() if len(h) <= LONGEST])
            out += [(own[h] if h in own else self.heads[h]) + b"".join(ids) for h, ids in zip(first, got)]
        return out


def encoder(path: str, most_pieces: int = MOST_PIECES) -> Encoder:
    """One encoder for each file and worker."""
    key = path, most_pieces
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def forget() -> None:
    """Drops the encoders of this worker, where a job follows that needs none."""
    _encoders.clear()
    settle()


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
