"""Token ids of whole texts under a public vocabulary that drops white space, through a cache of words."""

from __future__ import annotations

import re

import numpy as np

from veritrail.llm.common import lower_table, slices

#: Units remembered by a worker; when full the memory is emptied, which changes no result. Units encoded in one call.
MEMORY, CALL = 500_000, 20_000
#: Bytes of text to split in one go.
LOT = 1 << 20
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def cut_marks(low: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int]]:
    """Texts with a space before each full stop and comma that follows a letter, where any vocabulary that tells letters
    from marks cuts; and where they begin and end now. Letters are a-z and those of Latin-1, in UTF-8."""
    after = np.flatnonzero((low == 46) | (low == 44))
    after = after[after > 0]
    last, before = low[after - 1], low[np.maximum(after, 2) - 2]
    wide = (before == 0xC3) & (after > 1) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
    after = after[(last >= 97) & (last <= 122) | wide]
    return np.insert(low, after, 32).tobytes(), (at + np.searchsorted(after, at)).tolist()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest) if b != 32}


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    For vocabularies in lower case whose pieces never reach over white space, nor over the border of a letter and a
    mark: a text's ids are its units' ids in a row, a unit being what lies between two such places. So each
    distinct unit is encoded once. Units of letters alone go straight to the merges where that gives the same.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special)) if special else None
        self.model, self.bytes = self.tokenizer.model, byte_letters()
        self.packed = [np.array(i, "<u4").tobytes() for i in range(max(self.tokenizer.get_vocab(True).values()) + 1)]
        self.known: dict[bytes, bytes] = {}
        probe = [b"abc", b"the", "\u00e9t\u00c9".encode(), b"xqzjkv"]
        self.one_by_one(probe)
        self.plain = [self.known[p] for p in probe] == self.pieces(probe)
        self.known.clear()

    def pieces(self, units: list[bytes]) -> list[bytes]:
        """Of units of letters, straight from the merges: no rule before them changes more than their case."""
        joined = b" ".join(units)
        words = (joined.decode() if joined.isascii() else joined.decode().lower().encode().decode("latin-1").translate(self.bytes)).split(" ")
        split, packed = self.model.tokenize, self.packed
        return [b"".join([packed[x.id] for x in split(w)]) for w in words]

    def learn(self, units: set[bytes]) -> None:
        new = units.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = units
        plain = [u for u in new if LETTERS.fullmatch(u)] if self.plain else []
        wide = [u for u in plain if not u.isascii()]
        for some in (wide, [u for u in plain if u.isascii()]):
            if some:
                self.known.update(zip(some, self.pieces(some)))
        odd = [u for u in new if u not in self.known]
        for i in range(0, len(odd), CALL):
            self.one_by_one(odd[i : i + CALL])

    def one_by_one(self, units: list[bytes]) -> None:
        self.tokenizer.encode_special_tokens = True  # units are in lower case, where a spelling may look special that isn't
        encoded = self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)
        self.known.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(units, encoded))

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of each text, in order."""
        lower = lower_table()
        for i, j in slices(offsets, LOT):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            flat, cuts = cut_marks(lower[part], at)
            texts = [flat[s:e].split() for s, e in zip(cuts, cuts[1:])]
            marked = self.special_texts(part.tobytes(), at.tolist())
            for k in marked:
                texts[k] = []
            self.learn(set().union(*texts))
            get = self.known.__getitem__
            for k, units in enumerate(texts):
                if k in marked:  # a special token's spelling, which the vocabulary reads before all else
                    self.tokenizer.encode_special_tokens = False
                    yield np.array(self.tokenizer.encode(marked[k], add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield b"".join(map(get, units))

    def special_texts(self, raw: bytes, at: list[int]) -> dict[int, str]:
        """Texts that hold a special token's spelling, by number."""
        if not self.special or not self.special.search(raw):
            return {}
        return {k: raw[s:e].decode("utf-8", "replace") for k, (s, e) in enumerate(zip(at, at[1:])) if self.special.search(raw, s, e)}
