"""Token ids of whole batches of texts.

A text is cut before blanks and line feeds that follow a visible character: no token of a
byte-level BPE reaches over such a place. Equal pieces have equal ids, so each piece that a
worker has not met yet goes through the tokenizer, and the rest is copied.
"""

from __future__ import annotations

import os

import numpy as np

from cargolens.llm.textbytes import caches, ragged, span_hashes

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker remembers; at more it starts anew. Bounds memory, not results.
MEMORY = 4_000_000
#: Longer pieces go through the tokenizer each time.
LONGEST = 64

_encoders: dict[str, Encoder] = {}
caches.append(_encoders)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """This worker's encoder for the tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids by a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        size = self._library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        special = self._library.get_added_tokens_decoder()
        #: Bytes that each id stands for: a character of a byte-level token is one byte.
        self._bytes = np.array(
            [
                len(special[i].content.encode()) if i in special else len(self._library.id_to_token(i) or "")
                for i in range(size)
            ],
            np.int64,
        )
        self._forget()

    def _forget(self) -> None:
        self._keys = np.empty(0, np.uint64)
        self._place = np.empty(0, np.int64)
        self._starts = np.empty(0, np.int64)
        self._counts = np.empty(0, np.int64)
        self._ids = np.empty(0, self.dtype)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    @staticmethod
    def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and which byte may stand before a cut.

        White space of more than one byte is no place to cut after: C2 85, C2 A0 and
        three-byte characters that begin with E1, E2 or E3.
        """
        visible = (data > 32) & (data != 127)
        if len(data) > 2:
            visible[1:] &= ~(((data[1:] == 0x85) | (data[1:] == 0xA0)) & (data[:-1] == 0xC2))
            visible[2:] &= ~((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & (data[2:] >= 0x80))
        cut = (data == 32) | (data == 10)
        cut[1:] &= visible[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut), visible

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets into them) of texts given as bytes and offsets."""
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(offsets), np.int64)
        starts, visible = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        if len(self._keys) > MEMORY:
            self._forget()
        found, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == found[inside]
        self._learn(data, visible, starts[first[~known]], ends[first[~known]], found[~known])
        place = self._place[np.searchsorted(self._keys, found)][which]
        counts = self._counts[place]
        ids = self._ids[ragged(self._starts[place], counts)]
        self._drop_long()
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, offsets)]

    def _learn(self, data, visible, starts, ends, keys) -> None:
        if not len(keys):
            return
        alone = (data[starts] != 32) & (data[starts] != 10) | ~visible[ends - 1]
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        starts, ends, keys = starts[order], ends[order], keys[order]
        joined = int((~alone).sum())
        ids, counts = [], np.empty(len(keys), np.int64)
        if joined:
            sizes = ends[:joined] - starts[:joined]
            text = data[ragged(starts[:joined], sizes)].tobytes().decode()
            (made,) = self._encode([text])
            upto = np.searchsorted(np.cumsum(self._bytes[made]), np.cumsum(sizes)) + 1
            counts[:joined] = np.diff(upto, prepend=0)
            ids.append(made)
        if joined < len(keys):
            raw = data.tobytes()
            made = self._encode([raw[a:b].decode() for a, b in zip(starts[joined:], ends[joined:])])
            counts[joined:] = [len(x) for x in made]
            ids += made
        first = len(self._counts)
        self._starts = np.append(self._starts, len(self._ids) + np.cumsum(counts) - counts)
        self._counts = np.append(self._counts, counts)
        self._ids = np.concatenate([self._ids, *ids])
        order = np.argsort(keys)
        at = np.searchsorted(self._keys, keys[order])
        self._keys = np.insert(self._keys, at, keys[order])
        self._place = np.insert(self._place, at, first + order)

    def _drop_long(self) -> None:
        """Forget everything when long pieces have filled the memory."""
        if len(self._ids) > MEMORY * 8:
            self._forget()
