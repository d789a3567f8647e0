"""Token ids of whole texts: the ids of a batch's distinct words are looked up once and gathered."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Signs whose small letters, composition and classes the shortcut treats as the tokenizer does.
_PLAIN = re.compile(r"[\x00-ɏ]*")


#: Byte -> the sign that stands for it in a byte-level vocabulary: printable Latin-1 as it is, the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


def strings(array: pa.Array) -> list[str]:
    """`array.to_pylist()` by way of numpy, which is ten times as fast."""
    return array.to_numpy(zero_copy_only=False).tolist()


def gathered(ids: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of `ids` that `codes` name, one after another, and where each of them ends."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    start = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    return np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[codes] - ends + n, n) + np.arange(n.sum())], ends


class TokenIds:
    """Little-endian unsigned 32-bit ids of texts.

    Pre-tokenizing never joins what white space parts, so ids of a text are those of its words, one after
    another. The distinct words of a batch are found in Arrow, each is looked up once, and the ids of the texts
    are gathered by place. If the file is a lower-casing word tokenizer with one split pattern, the distinct words
    are parted further by that pattern, all at once, and only parts that are not known are looked up. A full
    memory, of parts or of other words, starts anew from those of the batch.
    """

    def __init__(self, tokenizer_json: str, pattern: str | None = None, most: int = 100_000):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.pattern, self.most = regex.compile(rf"\n|{pattern}") if pattern else None, most
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part == "\n":  # parts two words
            return b""
        # all other steps of the tokenizer are done by now: what is left is the merges
        signs = part if part.isascii() and part.isprintable() else "".join(map(_SIGNS.__getitem__, part.encode()))
        found = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(found)}I", *found)

    def _known(self, memory: dict[str, bytes], names: list[str], new: Callable[[str], bytes], most: int) -> list[bytes]:
        """The ids of distinct `names`; those that `memory` lacks are looked up and kept."""
        ids = [memory.get(name) for name in names]
        missed = [i for i, found in enumerate(ids) if found is None]
        for i in missed:
            ids[i] = new(names[i])
        if len(memory) + len(missed) > most:
            memory.clear()
            memory.update(zip(names[:most], ids, strict=False))  # the frequent ones are among them
        else:
            memory.update((names[i], ids[i]) for i in missed)
        return ids

    def _parted(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain signs. Lines part the words, and neither small letters nor the pattern depend on what another line holds."""
        coded = pa.array(self.pattern.findall("\n".join(words).lower()), pa.string()).dictionary_encode()
        names, codes = strings(coded.dictionary), coded.indices.to_numpy()
        out, ends = gathered(self._known(self.parts, names, self._part, 2 * self.most), codes)
        line = names.index("\n") if len(words) > 1 else -1
        cuts = [0, *(4 * ends[codes == line]).tolist(), 4 * len(out)]
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _plain(self, words: list[str]) -> list[bool]:
        if self.pattern is None:
            return [False] * len(words)
        return [(word.isascii() or _PLAIN.fullmatch(word) is not None) and "<|" not in word for word in words]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an array of strings; none for null."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        names = strings(coded.dictionary)
        plain = self._plain(names)
        parted = iter(self._parted([w for w, is_plain in zip(names, plain, strict=True) if is_plain]) if any(plain) else ())
        others = iter(self._known(self.words, [w for w, is_plain in zip(names, plain, strict=True) if not is_plain], self._encoded, self.most))
        ids = [next(parted if is_plain else others) for is_plain in plain]
        out, ends = gathered(ids, coded.indices.to_numpy())
        cuts = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def __call__(self, text: str | None) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=1)
def token_ids(tokenizer_json: str, pattern: str | None) -> TokenIds:
    """One memory of words for all tasks that a Python worker runs in turn."""
    return TokenIds(tokenizer_json, pattern)
