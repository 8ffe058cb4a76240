"""Whole-text encoding with the tokenizers library, each distinct chunk encoded once per worker.

Texts are cut into chunks that the tokenizer treats independently: at spaces, single line feeds, and before
the marks that end a word. A dictionary from chunk to ids is kept in the worker and refilled
when it holds ``max_chunks`` entries, so memory is bounded. Ids of texts are then gathered from flat arrays.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .common import keep_freed_memory, return_freed_memory

#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: How vocabularies without spaces mark the end of a word.
WORD_END = "</w>"
#: Words of Latin letters that have one composed form, with a leading space or not.
LATIN = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]+$"
#: A Latin letter, then marks other than letters, digits and combining ones to the end of the chunk. (The
#: letter left out, U+0130, ends in a combining mark once it is lower case.)
TAIL = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([^\s\pL\pN\pM]+)( |\n|$)"
#: Marks cuts inside texts where spaces count; texts that hold it are encoded as a whole.
CUT = "\x1f"
#: Characters, and words, that the library gets at once: its notes on them take about 70 times their size.
LOT_CHARACTERS, LOT_WORDS = 1 << 18, 1 << 14


#: White space other than a space, and chunks whose edges have some (or a second space) that could belong to a neighbour's word.
WHITE = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = f"^ ?$|^[{WHITE}]|^ [ {WHITE}]|[ {WHITE}]$"


def _odd(chunks: pa.Array) -> np.ndarray:
    """Whether white space at a chunk's edges could belong to a neighbour's word; a line feed alone is a chunk."""
    return pc.and_(pc.match_substring_regex(chunks, ODD), pc.not_equal(chunks, "\n")).to_numpy(zero_copy_only=False)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the slices [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def lots(chunks: list[str], most: int):
    """The chunks in lists of at most ``most`` characters in all; a longer one is a list of its own."""
    begin = size = 0
    for i, chunk in enumerate(chunks):
        if i > begin and size + len(chunk) > most:
            yield chunks[begin:i]
            begin, size = i, 0
        size += len(chunk)
    if begin < len(chunks):
        yield chunks[begin:]


class ChunkEncoder:
    """``white_space_dropped``: the tokenizer lower-cases and its words never hold white space, so texts are cut
    at every space and line feed. Otherwise a word may begin with one space: texts are cut before each single
    space between visible characters, and a text with any other space next to white space is encoded as a
    whole. ``end_id`` is appended to every text.
    """

    def __init__(self, path: str, end_id: int, white_space_dropped: bool, max_chunks: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end_id, self.dropped, self.max_chunks = end_id, white_space_dropped, max_chunks
        # for words of plain letters the whole normalising and splitting is to cut at line feeds
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if white_space_dropped:  # and bytes of ASCII letters stand for themselves
            self.ascii = Tokenizer.from_file(path)
            self.ascii.encode_special_tokens = True
            self.ascii.normalizer = None
            self.ascii.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin (or, without spaces, end) a word
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith(WORD_END) if white_space_dropped else token.startswith(SPACE)
        self._clear()

    def _clear(self):
        # entry 0 is the end id, under a name that no chunk has
        self.known = pa.array(["\n" if self.dropped else CUT], pa.string())
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([self.end_id], np.int32)

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in one array, and how many each has; one call for each lot of them."""
        parts, lengths = [np.zeros(0, np.int32)], []
        for lot in lots(chunks, LOT_CHARACTERS):
            rows = self._ids(lot)
            lengths += map(len, rows)
            parts.append(np.fromiter(chain.from_iterable(rows), np.int32))
        return np.concatenate(parts), np.array(lengths, np.int64)

    def _joined(self, words: pa.Array, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in one array, and how many each has; one call for each lot of them."""
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for a in range(0, len(words), LOT_WORDS):
            lot = words.slice(a, LOT_WORDS)
            one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lot)], pa.int32()), lot), "\n")[0].as_py()
            ids = np.array(tokenizer.encode_batch_fast([one], add_special_tokens=False)[0].ids, np.int32)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(lot):
                raise AssertionError("the tokenizer does not keep chunks apart")
            parts.append((ids, np.diff(edges, prepend=-1) if self.dropped else np.diff(edges, append=len(ids))))
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        return ids, lengths

    def _is_plain(self, chunks: pa.Array) -> pa.Array:
        """Which chunks are words of Latin letters (after a space, where spaces count) that normalising leaves."""
        latin = pc.match_substring_regex(chunks, LATIN)
        if self.dropped:
            return pc.and_(latin, pc.equal(chunks, pc.utf8_lower(chunks)))
        return pc.and_(latin, pc.starts_with(chunks, " "))

    def _entries(self, chunks: pa.Array) -> np.ndarray:
        """The entry of each chunk; new ones are encoded."""
        place = pc.index_in(chunks, value_set=self.known)
        if place.null_count:
            missing = chunks.filter(pc.is_null(place))
            new = pc.unique(missing)
            plain = self._is_plain(new)
            simple = pc.and_(plain, pc.string_is_ascii(new)) if self.dropped else pc.and_(plain, False)
            other, words, simple = (new.filter(x) for x in (pc.invert(plain), pc.and_not(plain, simple), simple))
            parts = [self._encoded(other.to_pylist()),
                     self._joined(words, self.plain), self._joined(simple, self.ascii if self.dropped else self.plain)]
            ids, lengths = (np.concatenate(x) for x in zip(*parts))
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            added, before = pa.concat_arrays([other, words, simple]), len(self.known)
            self.known = pa.concat_arrays([self.known, added])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            found = pc.add(pc.index_in(missing, value_set=added), pa.scalar(before, pa.int32()))
            place = pc.replace_with_mask(place, pc.is_null(place), found)
        return place.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        if len(self.known) > self.max_chunks:
            self._clear()
        if self.dropped:
            spaced = pc.replace_substring_regex(texts, TAIL, r"\1 \2\3")
            cut = pc.split_pattern(pc.replace_substring(spaced, "\n", " "), " ")
        else:
            marked = pc.replace_substring_regex(texts, TAIL, "\\1" + CUT + "\\2\\3")
            marked = pc.replace_substring_regex(marked, r"([^\s])\n([^\s])", "\\1" + CUT + "\n" + CUT + "\\2")
            cut = pc.split_pattern(pc.replace_substring(marked, " ", CUT + " "), CUT)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = cut.flatten().dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        whole = np.zeros(0, np.int64)
        if self.dropped:
            distinct = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct)
        elif len(which):
            odd = _odd(distinct)[which]
            odd = np.add.reduceat(odd, offsets[:-1]) > 0
            whole = np.flatnonzero(odd | pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False))
        entries = self._entries(distinct)[which]
        counts = np.diff(offsets)
        entries = np.insert(entries, offsets[1:], 0)
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        lengths = self.lengths[entries]
        ids = self.ids[ragged(self.starts[entries], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        if len(whole):
            replaced, own = self._encoded([texts[int(i)].as_py() for i in whole])
            end = np.array([self.end_id], np.int32)
            pieces, last = [], 0
            sizes = np.diff(at)
            for i, row in zip(whole, np.split(replaced, np.cumsum(own)[:-1])):
                pieces += [ids[last:at[i]], row, end]
                last, sizes[i] = at[i + 1], len(row) + 1
            ids = np.concatenate([*pieces, ids[last:]])
            at = np.concatenate([[0], np.cumsum(sizes)])
        return ids, at


@lru_cache(maxsize=2)
def chunk_encoder(path: str, end_id: int, white_space_dropped: bool, max_chunks: int = 700_000, kept: int = 96 << 20) -> ChunkEncoder:
    """One encoder for each worker process, kept from task to task. What earlier operators left free goes back first,
    and what reading the vocabulary took; of later memory about ``kept`` bytes are kept free."""
    return_freed_memory()
    keep_freed_memory(kept=kept)
    encoder = ChunkEncoder(path, end_id, white_space_dropped, max_chunks)
    return_freed_memory()
    return encoder


def release_encoders() -> None:
    """In a worker that goes on to an operator without tokens: let go of the dictionaries kept for the last one."""
    if chunk_encoder.cache_info().currsize:
        chunk_encoder.cache_clear()
        return_freed_memory()


def by_size(batches, text_column: str = "text", max_bytes: int = 8 << 20):
    """Slices of the batches of about ``max_bytes`` of text; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
