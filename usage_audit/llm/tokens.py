"""Token ids of texts, made inside tasks.

The vocabulary files' folder is a parameter: it holds ``byte_bpe_50k.json``, ``byte_bpe_50k.tiktoken`` and
``word_bpe_49k.json``. The ids of every text are those of ``Tokenizer.from_file(...).encode(text,
add_special_tokens=False)``, the strings of added tokens included.

Both tokenizers work piece by piece: a text's ids are those of its pieces in turn, so each distinct piece of a slice is
encoded once, and its ids are copied to all places where it stands.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker remembers the ids of at most so many distinct pieces, a few MB.
REMEMBERED = 400_000
#: Texts are taken in slices of about so many bytes.
SLICE = 6 << 20
#: NFC and lower-casing keep the number of bytes of a word of these characters.
_KEPT = "^[!-~À-ÖØ-öø-ÿ]+$"
#: A space between two characters of white space, or at the end after one: there a piece can't be cut at each space.
_SPACES = r"[\s\v\x1c-\x1f\x{85}\pZ] ([\s\v\x1c-\x1f\x{85}\pZ]|$)"
#: Pieces are told apart in a joined text by this mark, a token of its own.
_MARK = " \x01"

Encoded = tuple[np.ndarray, np.ndarray]


def vocabulary_dir() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of at most `most` bytes in column `text`, or of one row."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _joined(pieces: pa.Array, between: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), between)[0].as_py()


def _flat(lists: list[list[int]]) -> Encoded:
    """All ids, and the number of each list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.uint16, int(sizes.sum())), sizes


class _Pieces:
    """The ids of distinct pieces, made by `encode` and remembered as long as they are used."""

    def __init__(self, encode: Callable[[pa.Array], Encoded]) -> None:
        self.encode = encode
        self.known, self.pool, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def __call__(self, pieces: pa.Array) -> Encoded:
        """The ids of all `pieces`, which may repeat, and the number of each."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(at.is_null())
        was = len(self.known)
        if len(new):
            ids, sizes = self.encode(new)
            self.known = pa.concat_arrays([self.known, new])
            self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = was + np.arange(len(new))
        first = np.cumsum(self.sizes) - self.sizes
        place = coded.indices.to_numpy()
        n, begin = self.sizes[at][place], first[at].astype(np.int32)[place]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        begin -= (ends - n).astype(np.int32)
        out = self.pool[np.repeat(begin, n) + np.arange(total, dtype=np.int32)]
        if len(self.known) > REMEMBERED:  # what was used twice here, or was known before and is used again, stays
            stays = np.sort(at[(np.bincount(place, minlength=len(at)) > 1) | (at < was)])[-REMEMBERED // 2 :]
            sizes = self.sizes[stays]
            ends = np.cumsum(sizes)
            self.pool = self.pool[np.repeat(first[stays] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
            self.known, self.sizes = self.known.take(pa.array(stays)), sizes
        return out, n


def _cut(ids: np.ndarray, sizes: np.ndarray, parents: pa.Array) -> list[bytes]:
    """The ids of each list of pieces, as bytes."""
    bound = np.append(0, np.cumsum(sizes))[parents.offsets.to_numpy() - parents.offsets[0].as_py()].tolist()
    return [ids[i:j].tobytes() for i, j in zip(bound, bound[1:], strict=False)]


class _Bytes:
    """Byte-level BPE: a piece begins at each space.

    Texts with an added token's string, or with a space inside longer white space, are encoded whole by the tokenizer;
    pieces of all others hold neither, and the ranks of that vocabulary give the same ids several times faster.
    """

    def __init__(self, folder: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))
        self.added = "|".join([_SPACES, _MARK[-1], *(f"\\Q{t.content}\\E" for t in self.tokenizer.get_added_tokens_decoder().values())])
        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ranks = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = self.ranks.encode_ordinary(_MARK)
        self.later, self.firsts = _Pieces(lambda p: self.made(p, " ")), _Pieces(lambda p: self.made(p, ""))

    def made(self, pieces: pa.Array, lead: str) -> Encoded:
        if not lead:
            return _flat([self.ranks.encode_ordinary(p) for p in pieces.to_pylist()])
        text = lead + _joined(pieces, _MARK + lead) + _MARK
        ids = self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
        ends = np.flatnonzero(ids == self.mark[-1])  # no other token holds that byte
        sizes = np.diff(ends, prepend=-1) - len(self.mark)
        marks = np.zeros(len(ids), bool)
        for i in range(len(self.mark)):
            marks[ends - i] = True
        return ids[~marks], sizes

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.added)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        pieces = lists.flatten()
        is_first = np.zeros(len(pieces), bool)
        is_first[begins] = True
        ids, sizes = self.later(pieces.filter(pa.array(~is_first)))
        first_ids, first_sizes = self.firsts(pieces.take(pa.array(begins)))
        all_sizes = np.zeros(len(pieces), np.int64)
        all_sizes[~is_first], all_sizes[begins] = sizes, first_sizes
        of_first = np.repeat(is_first, all_sizes)
        all_ids = np.zeros(len(of_first), np.uint16)
        all_ids[~of_first], all_ids[of_first] = ids, first_ids
        out = _cut(all_ids, all_sizes, lists)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16).tobytes()
        return out


class _Words:
    """Word BPE: white space is dropped and nothing is joined across it, so the pieces are the words."""

    def __init__(self, folder: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "word_bpe_49k.json"))
        vocabulary = self.tokenizer.get_vocab()
        added = set(self.tokenizer.get_added_tokens_decoder())
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # that an id spells: one character a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token) if i in added else len(token.removesuffix("</w>"))
        self.words = _Pieces(self.made)

    def made(self, words: pa.Array) -> Encoded:
        """Of words whose bytes are kept, all at once: their ids spell as many bytes; of others, one by one."""
        kept = pc.match_substring_regex(words, _KEPT)
        joined, other = words.filter(kept), words.filter(pc.invert(kept))
        ids = np.array(self.tokenizer.encode_batch_fast([_joined(joined, " ")], add_special_tokens=False)[0].ids, np.uint16)
        spelt = np.append(0, np.cumsum(self.bytes[ids]))
        ends = np.cumsum(pc.binary_length(joined).to_numpy())
        at = np.searchsorted(spelt, ends)
        assert len(ends) == 0 or (spelt[-1] == ends[-1] and (spelt[at] == ends).all())
        sizes = np.diff(at, prepend=0)
        if not len(other):
            return ids, sizes
        others, other_sizes = _flat([e.ids for e in self.tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)])
        mask = kept.to_numpy(zero_copy_only=False)
        all_sizes = np.zeros(len(words), np.int64)
        all_sizes[mask], all_sizes[~mask] = sizes, other_sizes
        of = np.repeat(mask, all_sizes)
        all_ids = np.zeros(len(of), np.uint16)
        all_ids[of], all_ids[~of] = ids, others
        return all_ids, all_sizes

    def __call__(self, texts: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        return _cut(*self.words(lists.flatten()), lists)


@functools.lru_cache(maxsize=1)
def byte_encoder(folder: str) -> _Bytes:
    """A function from texts to their byte-level BPE ids, as unsigned 16-bit integers in bytes."""
    return _Bytes(folder)


@functools.lru_cache(maxsize=1)
def word_encoder(folder: str) -> _Words:
    """A function from texts to their word BPE ids, as unsigned 16-bit integers in bytes."""
    return _Words(folder)
