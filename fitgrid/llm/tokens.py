"""Token ids by a public tokenizer, with words encoded once per task."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A space or newline that more white space or the end follows: white space runs
# are tokens that reach over the cuts made below, so such texts are encoded whole.
_WHOLE = r"^[ \n]|^$|[ \n]([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
_TAIL = ".,;:!?*%$#&)"  # ASCII punctuation: never in one token with a letter or digit before it
_CACHE_ENTRIES = 400_000
_ENCODERS: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str) -> "WordEncoder":
    """The Python worker's encoder; workers are reused, and so are the words they know."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget_words() -> None:
    """Free what the worker's encoders know; for tasks of other kinds that follow in the same worker."""
    for known in _ENCODERS.values():
        known.forget()


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own.

    The pre-tokenizer never joins a character with a space or newline that
    follows it, nor a letter or digit with punctuation behind it. Where every
    space and newline stands alone, a text may be cut before each of them, and
    equal pieces need encoding only once. Arrow cuts a batch of texts and numbers
    its pieces; each piece that differs is looked up once, as stem and
    punctuation, and the ids of the texts are gathered by number. New words are
    encoded in long lines; the ids that begin with the separator show where each
    word starts. Any other text goes through the tokenizer as it is. What is known
    is one Arrow array of words beside flat ids, a sixth of what strings in a dict
    take; it is emptied when full.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.begins = {" ": np.array([n[:1] == "\u0120" for n in names]),
                       "\n": np.array([n[:1] == "\u010a" for n in names])}

    def forget(self) -> None:
        """Know no word but the empty one, which has no ids."""
        self.words, self.ids, self.sizes = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int32)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _parts(self, words: list[str], separator: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of separator + word for words without white space, end to end, and how many each has."""
        out = []
        for at in range(0, len(words), 10_000):
            part = words[at:at + 10_000]
            line = self.tokenizer.encode_batch_fast(
                [separator + separator.join(part)], add_special_tokens=False)[0]
            ids = np.asarray(line.ids, "<u4")
            starts = np.flatnonzero(self.begins[separator][ids])
            if len(starts) == len(part):
                out.append((ids[starts[0]:], np.diff(starts, append=len(ids))))
            else:  # a vocabulary that marks words otherwise
                out.append(_flat(self._whole([separator + w for w in part])))
        return out

    def _known(self, stems: pa.Array) -> np.ndarray:
        """Numbers, among the known words, of pieces: " word" without its space, "\\nword" with its newline, a first word behind "\\r"."""
        at = pc.index_in(stems, value_set=self.words)
        if at.null_count:
            new = pc.unique(stems.filter(pc.is_null(at)))
            first, line = pc.starts_with(new, "\r"), pc.starts_with(new, "\n")
            kinds = [new.filter(x) for x in (first, line, pc.invert(pc.or_(first, line)))]
            learned = [_flat(self._whole([s[1:] for s in kinds[0].to_pylist()])),
                       *self._parts([s[1:] for s in kinds[1].to_pylist()], "\n"),
                       *self._parts(kinds[2].to_pylist(), " ")]
            new = pa.concat_arrays(kinds)
            at = pc.coalesce(at, pc.add(pc.index_in(stems, value_set=new), pa.scalar(len(self.words), pa.int32())))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate([self.ids, *[ids for ids, _ in learned]])
            self.sizes = np.concatenate([self.sizes, *[sizes for _, sizes in learned]]).astype(np.int32)
        return np.asarray(at)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut, end to end, and how many each has."""
        lists = pc.split_pattern(pc.replace_substring(
            pc.binary_join_element_wise("\r", texts, ""), "\n", " \n"), " ")
        pieces = lists.flatten().dictionary_encode()
        stems = pc.utf8_rtrim(pieces.dictionary, characters=_TAIL)
        parted = pc.match_substring_regex(stems, r"[\p{L}\p{N}]$")
        ends = pc.if_else(parted, pc.struct_field(pc.extract_regex(
            pieces.dictionary, "(?P<end>[" + re.escape(_TAIL) + "]*)$"), "end"), "").dictionary_encode()
        # an end is a first word of its own: it follows a letter, not a space
        tails = pc.if_else(pc.equal(ends.dictionary, ""), "", pc.binary_join_element_wise("\r", ends.dictionary, ""))
        at = self._known(pa.concat_arrays([pc.if_else(parted, stems, pieces.dictionary), tails]))  # looked up at once
        both = np.empty((len(stems), 2), np.int64)
        both[:, 0] = at[:len(stems)]
        both[:, 1] = at[len(stems):][np.asarray(ends.indices)]
        found, sizes = _gathered(self.ids, self.sizes, both.ravel())
        ids, per_piece = _gathered(found, sizes.reshape(-1, 2).sum(axis=1, dtype=np.int64), np.asarray(pieces.indices))
        upto = np.concatenate(([0], np.cumsum(per_piece)))
        return ids, np.diff(upto[np.asarray(lists.offsets) - lists.offsets[0].as_py()])

    def ragged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, little-endian unsigned 32-bit, and how many each has; null is empty."""
        if len(self.words) > _CACHE_ENTRIES:
            self.forget()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE)
        for mark in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        if not pc.any(whole).as_py():
            return self._cut(texts) if len(texts) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        rest = _flat(self._whole(texts.filter(whole).to_pylist()))
        ids, counts = [rest[0]], [rest[1]]
        if not pc.all(whole).as_py():
            for known, found in zip((ids, counts), self._cut(texts.filter(pc.invert(whole))), strict=True):
                known.append(found)
        order = np.argsort(~np.asarray(whole.to_numpy(zero_copy_only=False), bool), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return _gathered(np.concatenate(ids), np.concatenate(counts), place)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        ids, counts = self.ragged(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        data, ends = ids.tobytes(), np.cumsum(counts) * 4
        return [data[b - 4 * n:b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _flat(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and how many each has."""
    return np.frombuffer(b"".join(found), "<u4"), np.asarray([len(x) // 4 for x in found], np.int64)


def _gathered(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` (one of each of ``sizes``, end to end) that ``codes`` number, end to end, and their sizes."""
    counts = sizes[codes].astype(np.int64)
    begins = (np.cumsum(sizes, dtype=np.int64) - sizes)[codes] - (np.cumsum(counts) - counts)
    return values[np.repeat(begins, counts) + np.arange(counts.sum())], counts


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``chars`` characters, or of one row."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.utf8_length(batch.column(column)), 0)).tolist()
        begin, total = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > chars:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
        pa.default_memory_pool().release_unused()  # the pool of a worker that lives on would keep its peak


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = 4_000_000):
    """The slices with their texts; null is empty."""
    for part in slices(batches, column, chars):
        yield part, [t or "" for t in part.column(column).to_pylist()]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
