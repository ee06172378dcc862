"""Token ids of whole texts with a public tokenizer, word by word through a cache.

The word-level tokenizer never joins characters across white space, so the ids of a text are the ids
of its words in order.  Each Python worker keeps the ids of words it has met, as bytes.
"""

from __future__ import annotations

import numpy as np

from lanewise.llm.common import text_buffers

END_ID = 1
CACHE = 250_000
LONGEST = 64
TOGETHER = 2_000
_WORKERS: dict[tuple[str, int], WordIds] = {}
_TAILS = ".,;:!?|\"()[]{}*#$%&-"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


class WordIds(dict):
    """word -> its ids as little-endian bytes, ``width`` bytes each.

    Two generations bound the memory: when the young one is full it becomes the old one, and words
    that are met again move back.
    """

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype(f"<u{width}")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.old: dict[str, bytes] = {}
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words that are new in some texts together."""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        met: set[str] = set()
        for words in texts:
            met.update(words)
        met.difference_update(self)
        letters, tailed, other = [], [], []
        for w in met:
            if w in self.old:
                self[w] = self.old[w]
            elif len(w) > LONGEST:
                continue
            elif w.isalpha():
                letters.append(w)
            elif (core := w.rstrip(_TAILS)).isalpha():  # punctuation after letters has ids of its own
                tailed.append((w, core))
                letters.append(core)
            else:
                other.append(w)
        tails = {w[len(core) :] for w, core in tailed}
        self._each([*other, *(t for t in tails if t not in self)])
        self._runs([w for w in dict.fromkeys(letters) if w not in self])
        for w, core in tailed:
            self[w] = self[core] + self[w[len(core) :]]

    def _each(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self[word] = self._bytes(e.ids)

    def _runs(self, words: list[str]) -> None:
        """Words of letters, many in one text: each ends with its first word-end token."""
        width = self.kind.itemsize
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
            last = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
            if len(last) != len(part):  # a letter that normalises to something else
                self._each(part)
                continue
            data = ids.astype(self.kind).tobytes()
            at = 0
            for word, end in zip(part, (last * width).tolist(), strict=True):
                self[word] = data[at:end]
                at = end


def word_ids(path: str, width: int) -> WordIds:
    if (path, width) not in _WORKERS:
        _WORKERS[path, width] = WordIds(path, width)
    return _WORKERS[path, width]


def batch_ids(column, path: str, width: int = 4, most: int = 4 << 20):
    """Yields (row, bytes of the text's ids and the end id) over an Arrow string column."""
    import pyarrow as pa

    _, off = text_buffers(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    known = word_ids(path, width)
    end = np.array([END_ID], known.kind).tobytes()
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(off, off[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        texts = [words_of(t or "") for t in column.slice(row, stop - row).to_pylist()]
        known.learn(texts)
        for k, words in enumerate(texts):
            yield row + k, b"".join(map(known.__getitem__, words)) + end
        row = stop
