"""Exact token ids from the tokenizers library, with a bounded cache of the ids of pieces between blanks.

Where a text can be cut without changing its ids depends on the file's rules, so the cuts are chosen by kind:

* ``byte``: byte-level BPE whose patterns take one space to the word behind it. A single space between two characters
  that aren't blank always starts a token of its own; a text with a blank at an end or two in a row is encoded whole.
* ``word``: patterns that never hold white space; any run of space, tab or line ends can be cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow.compute as pc

from . import _text

#: Pieces kept by a Python worker for each kind of file, and their characters; beyond either the cache starts anew.
CACHE, CACHE_CHARS = {"byte": 1_400_000, "word": 900_000}, 16_000_000
#: A word whose lower case is as long, and marks behind it: two tokens' worth for a ``word`` file.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
_ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.chars = self.head_chars = 0
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        mark = str.startswith if kind == "byte" else str.endswith
        self.edge[[i for t, i in vocab.items() if mark(t, "\u0120" if kind == "byte" else "</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of units that each have one marked token, the first (``byte``) or the last (``word``): all in one text."""
        if not units:
            return []
        joint = "" if self.kind == "byte" else " "
        texts = [joint.join(units[i : i + 1000]) for i in range(0, len(units), 1000)]
        ids = np.frombuffer(b"".join(self._whole(texts)), "<u4")
        marks = np.flatnonzero(self.edge[ids])
        if len(marks) != len(units):
            return self._whole(units)
        cuts = [*marks.tolist(), len(ids)] if self.kind == "byte" else [0, *(marks + 1).tolist()]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of pieces as they stand behind a blank; a ``byte`` piece that isn't cut off by single blanks has none."""
        known = self.known
        if self.kind == "byte":
            sound = [x for x in fresh if x and not x[0].isspace() and not x[-1].isspace()]
            known.update(zip(sound, self._joined([f" {x}" for x in sound]), strict=True))
            return
        split = {x: m.groups() for x in fresh if (m := _SIMPLE.fullmatch(x))}
        hard = [x for x in fresh if x not in split]
        need = list({y for w, m in split.values() for y in (w.lower(), m) if y and y not in known})
        known.update(zip(need, self._joined(need), strict=True))
        for x, (w, m) in split.items():
            known[x] = known[w.lower()] + known[m] if m else known[w.lower()]
        known.update(zip(hard, self._whole(hard), strict=True))

    def _first(self, piece: str) -> bytes | None:
        """Ids of a ``byte`` text's first piece, with no blank before it."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        found = self.heads.get(piece)
        if found is None:
            found = self.heads[piece] = self._whole([piece])[0]
            self.head_chars += len(piece)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a null has none."""
        if len(self.known) > CACHE[self.kind] or self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        if len(self.heads) > CACHE[self.kind] // 8 or self.head_chars > CACHE_CHARS // 8:
            self.heads, self.head_chars = {}, 0
        get, byte = self.known.__getitem__, self.kind == "byte"
        out: list = [b""] * len(texts)
        cut, whole, new = [], [], set()
        for i, t in enumerate(texts):
            if not t:
                continue
            if byte:
                first, *rest = t.split(" ")
                start = self._first(first)
            else:
                start, rest = (None, ()) if _ODD.search(t) else (b"", t.split())
            if start is None:
                whole.append(i)
            else:
                new.update(rest)
                cut.append((i, start, rest))
        fresh = [x for x in new if x not in self.known]
        self.chars += sum(map(len, fresh))
        for at in range(0, len(fresh), 20_000):
            self._learn(fresh[at : at + 20_000])
        for i, start, rest in cut:
            try:
                out[i] = start + b"".join(map(get, rest))
            except KeyError:
                whole.append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This process's encoder; a Python worker that serves further tasks keeps what it has learned."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _text.trim()
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def runs(batch, limit: int = 4 << 20):
    """(doc_ids, texts) of a batch's first two columns in runs of about ``limit`` bytes, so that a batch of long texts
    never is in memory as ids at once."""
    lo, held = 0, 0
    lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
    for i, n in enumerate(lengths.tolist()):
        held += n
        if held >= limit:
            yield batch.column(0).slice(lo, i + 1 - lo).to_pylist(), batch.column(1).slice(lo, i + 1 - lo).to_pylist()
            lo, held = i + 1, 0
    if lo < batch.num_rows:
        yield batch.column(0).slice(lo).to_pylist(), batch.column(1).slice(lo).to_pylist()
