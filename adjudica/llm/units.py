"""Token ids of whole texts by the ``tokenizers`` library, a pre-token at a time.

A byte-level BPE tokenizer encodes each pre-token on its own, so equal pre-tokens have equal ids. Arrow's kernels
lower-case and cut a batch of texts, each distinct pre-token goes through the library's BPE model once, and numpy
gathers the ids. That holds for texts whose characters Arrow and the library lower-case and classify alike and
that NFC leaves alone (not ``NOT_PLAIN``); any other text goes through the library whole. A null or empty text has no
ids, texts of any length are encoded whole, equal texts have equal ids, and an array of none gives none.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "word_bpe_49k.json"

# Characters outside these ranges send a text through the library whole.
NOT_PLAIN = (
    r"[^\t\n\r\x{20}-\x{7e}\x{a1}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}"
    r"\x{391}-\x{3a1}\x{3a3}-\x{3a9}\x{3b1}-\x{3c9}\x{410}-\x{44f}"
    r"\x{2010}-\x{2027}\x{3001}-\x{3003}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]"
)
# The pre-tokenizer's alternatives but for runs of letters, in its order.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\pL\pN]+"
SPECIAL = "<|"
SLICE_BYTES = 4 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE has for each byte: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class UnitEncoder:
    """Encodes batches of texts. ``most`` bounds the remembered pre-tokens, and so the memory; beyond it, those
    that came back stay and the others are forgotten."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.most = most
        self.units = pa.array([""], pa.large_string())
        self.start, self.size, self.seen = (np.zeros(1, np.int32) for _ in range(3))
        self.pool = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keeps the pre-tokens that most batches held, half of ``most`` of them at most."""
        rank = np.argsort(-self.seen[1:], kind="stable")[: self.most // 2] + 1
        kept = np.concatenate([[0], np.sort(rank[self.seen[rank] >= 2])])
        starts, sizes = self.start[kept], self.size[kept]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.pool = self.pool[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        self.units, self.start, self.size = self.units.take(pa.array(kept)), ends[:-1], sizes
        self.seen = np.zeros_like(sizes)

    def learn(self, units: pa.Array) -> None:
        letters, tokenize = self.letters, self.model.tokenize
        words = units.to_pylist()
        made = [[t.id for t in tokenize(u if u.isascii() else "".join([letters[b] for b in u.encode()]))] for u in words]
        sizes = np.fromiter(map(len, made), np.int32, len(made))
        ends = np.cumsum(sizes) + len(self.pool)
        self.pool = np.concatenate([self.pool, np.fromiter((t for ids in made for t in ids), np.uint32, int(sizes.sum()))])
        self.units = pa.concat_arrays([self.units, units])
        self.start = np.concatenate([self.start, (ends - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes])
        self.seen = np.concatenate([self.seen, np.zeros_like(sizes)])

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > self.most:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), CUTS, r" \0 "))
        coded = lists.values.dictionary_encode()
        rows = pc.index_in(coded.dictionary, value_set=self.units)
        if rows.null_count:
            self.learn(coded.dictionary.filter(rows.is_null()))
            rows = pc.index_in(coded.dictionary, value_set=self.units)
        rows = rows.to_numpy(zero_copy_only=False)
        self.seen[rows] += 1
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = self.size[rows][codes]
        ends = np.zeros(len(codes) + 1, np.int64 if len(codes) > 1 << 26 else np.int32)
        np.cumsum(sizes, out=ends[1:])
        at = np.repeat(self.start[rows][codes] - ends[:-1], sizes)
        at += np.arange(ends[-1], dtype=at.dtype)
        return self.pool[at], ends[lists.offsets.to_numpy()].astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and where each text's ids start, with the end at last."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, NOT_PLAIN), pc.match_substring(texts, SPECIAL))
        if not pc.any(odd).as_py():
            return self.plain(texts)
        ids, offsets = self.plain(pc.if_else(odd, "", texts))
        pieces = np.split(ids, offsets[1:-1])
        for at in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            pieces[at] = np.array(self.tokenizer.encode(texts[int(at)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, length) of runs of texts of at most so many bytes, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > most:
            yield start, at - start
            start, held = at, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - start
