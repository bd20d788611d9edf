"""Encoding with a tokenizer file, with the ids of frequent words remembered, and decoding by table.

A text is cut into units where the tokenizer never joins two of them (see Codec._units); a unit that was met before
costs a lookup. Texts for which that isn't certain go to the tokenizers library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable
from itertools import filterfalse

import numpy as np
import pyarrow as pa

from ._blocks import table_of

#: Units that a process remembers at most; the first met are the most frequent ones.
REMEMBERED = 800_000
#: Characters of new units that are encoded as one text.
JOINED = 1 << 16

#: White space other than space, tab and line ends: tokenizers and re don't agree on all of it.
_RARE_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: What stands between units that are encoded together where spaces are dropped: a token of its own.
_MARK = " | "
_SPACES = table_of(b" \t\n\r")
#: What ends a unit where spaces are dropped.
_BREAKS = table_of(b" \n")
_UNITS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


class Codec:
    """Text to ids (little-endian bytes of self.dtype) and back, exactly as the tokenizers library does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(self.size, max(tokens.values(), default=0) + 1)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.passing: list[str] = []  # units that are known for now only
        self.coded: dict[bytes, bytes] = {}  # as known, by bytes, for encode_block
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.split = ""
        if not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]) and not spec.get("post_processor"):
            if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                self.split = "keeps spaces"
            elif self._drops_spaces(pre, normal):
                self.split = "drops spaces"
        self.joined = None
        if spec.get("decoder") is None:  # tokens with a space between
            names = {i: t for t, i in tokens.items()}
            self.joined = Strings([names.get(i, "").encode() for i in range(self.size)], [i in names for i in range(self.size)])
        self.digits = Strings([b"%d" % i for i in range(self.size)])
        # How many bytes each token stands for, if it is of bytes; the mark between units.
        self.sizes = np.zeros(self.size, np.int64)
        added = {t["id"] for t in spec["added_tokens"]}
        for t, i in tokens.items():
            self.sizes[i] = len(t.encode()) if i in added else len(t)
        self.mark = -1
        if self.split == "drops spaces":
            found = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
            self.mark = found[0] if len(found) == 1 else -1

    @staticmethod
    def _drops_spaces(pre: dict, normal: dict | None) -> bool:
        parts = [pre] if pre.get("type") != "Sequence" else pre["pretokenizers"]
        first = parts[0] if parts else {}
        pattern = (first.get("pattern") or {}).get("Regex", "")
        plain = {"NFC", "Lowercase", "Replace"}
        steps = [] if normal is None else normal.get("normalizers", [normal])
        # The pieces kept are letters, digits and other characters but white space: none has a space in it.
        return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "[^\\s" in pattern and " " not in pattern and all(s["type"] in plain for s in steps)

    def _units(self, text: str) -> list[str]:
        """Pieces whose ids, put together, are the text's.

        Where spaces are dropped, a space or line end always stands between two tokens. Where they are kept, a token
        can begin with white space but never goes on into white space after something else, so that a piece is a run of
        white space with what follows up to the next such run.
        """
        if self.split == "drops spaces":
            return text.replace("\n", " ").split(" ")
        if self.split == "keeps spaces" and not _RARE_SPACE.search(text):
            return _UNITS.findall(text)
        return [text]

    def _apart(self, units: list[str]) -> dict[str, bytes]:
        """The units' ids by the library, each for itself."""
        encoded = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return {u: np.array(e.ids, self.dtype).tobytes() for u, e in zip(units, encoded, strict=True)}

    def _together(self, units: list[str]) -> dict[str, bytes]:
        """The units' ids by encoding them as one text, which the library does much faster; none if that can't be.

        Where spaces are dropped a mark stands between two units, and its id tells where one ends. Where they are kept, bytes
        are counted: a token never goes on from a unit into the next one, which begins with white space.
        """
        if self.split == "drops spaces":
            ids = np.array(self.tokenizer.encode_batch_fast([_MARK.join(units)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            begins = np.append(0, ends[:-1] + 1)
            if len(ends) != len(units):
                return {}
        else:
            bare = [u[0] not in " \t\n\r" for u in units]
            text = "".join(["\n" + u if b else u for u, b in zip(units, bare, strict=True)])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            sizes = np.array([len(u) if u.isascii() else len(u.encode()) for u in units], np.int64) + bare
            read, due = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
            ends = np.searchsorted(read, due) + 1
            begins = np.append(0, ends[:-1])
            if ends[-1] != len(ids) or (read[ends - 1] != due).any() or (self.sizes[ids[begins[bare]]] != 1).any():
                return {}
            begins = begins + bare
        data, width = ids.tobytes(), self.dtype.itemsize
        return dict(zip(units, [data[a:b] for a, b in zip((begins * width).tolist(), (ends * width).tolist(), strict=True)], strict=True))

    def _learn(self, units: Iterable[str]) -> dict[str, bytes]:
        """The ids of new units, each given once."""
        odd = "|" if self.split == "drops spaces" else ""
        found: dict[str, bytes] = {}
        apart, some, held = [], [], 0

        def flush() -> None:
            made = self._together(some) if some else {}
            found.update(made)
            if not made:
                apart.extend(some)

        for u in units:
            if not self.split or not u or (odd and odd in u) or u.isspace():
                apart.append(u)
                continue
            some.append(u)
            held += len(u)
            if held > JOINED:
                flush()
                some, held = [], 0
        flush()
        return found | self._apart(apart) if apart else found

    def _remember(self, units: set[str]) -> None:
        full = len(self.known) >= REMEMBERED
        self.passing += [u for u in units if full or len(u) > 64]
        self.known.update(self._learn(units))

    def _forget(self) -> None:
        for u in self.passing:
            self.known.pop(u, None)
        self.passing = []

    def encode(self, text: str) -> bytes:
        units, known = self._units(text), self.known
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            if len(self.passing) > REMEMBERED // 4:
                self._forget()
            self._remember(set(filterfalse(known.__contains__, units)))
            return b"".join(map(known.__getitem__, units))

    def learn_from(self, text: str) -> None:
        """Get ready for texts that this one is made of: one by one, they would be slower to learn."""
        self._forget()
        self._remember(set(filterfalse(self.known.__contains__, self._units(text))))

    def _cut(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the units of the texts begin (see _units); a text for which they aren't certain is one unit."""
        first = at[:-1][np.diff(at) > 0]
        if not self.split:
            return first
        keeps = self.split == "keeps spaces"
        space = (_SPACES if keeps else _BREAKS)[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        if keeps and _RARE_SPACE.search(data.tobytes().decode()):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if _RARE_SPACE.search(data[a:b].tobytes().decode()):
                    begins[a:b] = False
        begins[first] = True
        return np.flatnonzero(begins)

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (bytes and offsets) one behind the other, and how many each has.

        Equal units of the block are found in compiled code, so that each is looked up once.
        """
        begins = self._cut(data, at)
        offsets = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        found = list(map(self.coded.get, distinct))
        gaps = [k for k, v in enumerate(found) if v is None]
        if gaps:
            new = [distinct[k].decode() for k in gaps]
            learnt = self._learn(new)
            room = REMEMBERED - len(self.coded)
            for k, u in zip(gaps, new, strict=True):
                found[k] = value = learnt[u]
                if room > 0 and len(u) <= 64:
                    self.coded[distinct[k]] = value
                    room -= 1
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.array(list(map(len, found)), np.int64) // self.dtype.itemsize
        start = np.cumsum(size) - size
        nth = units.indices.to_numpy(zero_copy_only=False)
        n = size[nth]
        ends = np.cumsum(n)
        ids = flat[np.repeat(start[nth] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        run = np.append(0, ends)[np.searchsorted(begins, at)]
        return ids, np.diff(run)

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype)

    def count(self, data: bytes) -> int:
        return len(data) // self.dtype.itemsize

    def decimal(self, data: bytes) -> bytes:
        """The ids in decimal with a space between."""
        return self.digits.join(self.ids(data))

    def decode(self, data: bytes) -> bytes:
        """The text, in UTF-8."""
        if self.joined is not None:
            return self.joined.join(self.ids(data))
        return self.tokenizer.decode(self.ids(data).tolist(), skip_special_tokens=False).encode()


class Strings:
    """Strings by number, and sequences of numbers as those strings with a space between, by table lookup."""

    def __init__(self, strings: list[bytes], there: list[bool] | None = None, width: int = 24):
        self.strings, self.there = strings, None if there is None or all(there) else np.array(there)
        self.table = np.zeros((len(strings), width), np.uint8)
        self.sizes = np.array([len(x) + 1 for x in strings])
        self.wide = self.sizes > width
        for k, x in enumerate(strings):
            if not self.wide[k]:
                self.table[k, : len(x) + 1] = np.frombuffer(x + b" ", np.uint8)
        self.filled = np.arange(width) < self.sizes[:, None]

    def join(self, ids: np.ndarray) -> bytes:
        if self.there is not None:
            ids = ids[self.there[ids]]
        if self.wide[ids].any():
            return b" ".join(map(self.strings.__getitem__, ids.tolist()))
        return self.table[ids][self.filled[ids]].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each process and file."""
    return Codec(path)
