"""Whole-text token encoding with a public tokenizer, cached by white-space delimited chunk.

The vocabulary folds case, drops white space and none of its pre-token patterns spans it, so the ids
of a text are the ids of its chunks in order. A full stop or comma that ends a word and stands before
white space is a pre-token of its own, and is cut off so that fewer chunks differ. A task keeps the ids
of the chunks it has met, up to a bound; only unseen chunks go through the library, joined into long
strings to spare calls.

Worker processes outlive their tasks, so what a task remembers and frees goes back to the system when it
ends (``releasing``): a long job's workers stay as small as a short one's.
"""

from __future__ import annotations

import os

END_ID = 1
CACHE_ENTRIES = 500_000  # of at most CACHE_CHUNK_BYTES each, beside the entries of one slice
CACHE_CHUNK_BYTES = 64
JOINED_CHUNKS = 512

#: A stop or comma before white space that may belong to a longer pre-token: what precedes it is neither
#: white space nor an ASCII or Latin-1 letter or digit.
_JOINED_STOP = r"[^a-z0-9\s\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}][.,][ \n]"
_SPECIAL = "<|"


def word_table(column):
    """(index of every word, distinct words, end of each text's words) of an Arrow string column.

    Words are runs of bytes that are no ASCII white space."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, pa.scalar("", flat.type))  # white space at either end leaves an empty word
    if not pc.all(real, min_count=0).as_py():
        mask = real.to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(mask)])
        ends = np.cumsum(sizes)
        sizes = sums[ends] - sums[ends - sizes]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.cumsum(sizes)


def split_bytes(column) -> list[bytes]:
    """The values of an Arrow large_string array without nulls, as bytes."""
    import numpy as np

    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def chunk_column(column):
    """The texts with case folded and such stops set apart, where that cannot change their ids."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # A copy with offsets from zero: the kernel that folds case goes wrong on slices.
    column = pc.fill_null(column.cast(pa.large_string()), "").take(pa.array(range(len(column)), pa.int64()))
    lower = pc.ascii_lower(column)
    apart = lower
    for stop in (". ", ", ", ".\n"):
        apart = pc.replace_substring(apart, stop, f" {stop}")
    lower = pc.if_else(pc.match_substring_regex(lower, _JOINED_STOP), lower, apart)
    return pc.if_else(pc.match_substring(column, _SPECIAL), column, lower)  # special tokens are matched before case is folded


_encoders: dict[str, WordEncoder] = {}
_caches: list[dict] = []


def task_cache() -> dict:
    """A dictionary that is emptied when a task of this worker process ends."""
    _caches.append(cache := {})
    return cache


def trim(cache: dict) -> None:
    """Empty a cache that has reached its bound."""
    if len(cache) > CACHE_ENTRIES:
        cache.clear()


def release() -> None:
    """Empty the task caches and give freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    for cache in _caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        give_back(0)


def releasing(run):
    """``run`` over a task's batches, and release() when they end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes text columns; keeps the ids of the chunks it has met, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = task_cache()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = [False] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.ends_word[k] = token.endswith("</w>")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: each is one pre-token, whose last id alone ends a word."""
        import numpy as np

        ends_word, out = np.array(self.ends_word), []
        groups = [words[at : at + JOINED_CHUNKS] for at in range(0, len(words), JOINED_CHUNKS)]
        for group, enc in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, "<u4")
            cuts = ((np.flatnonzero(ends_word[ids]) + 1) * 4).tolist()
            if len(cuts) != len(group):  # a letter that the library does not take for one
                out += self._encode_mixed(group)
                continue
            raw, last = ids.tobytes(), 0
            for cut in cuts:
                out.append(raw[last:cut])
                last = cut
        return out

    def _encode_mixed(self, texts: list[str]) -> list[bytes]:
        """Ids of any chunks, told apart by the offsets of their tokens."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(texts), JOINED_CHUNKS):
            part = texts[at : at + JOINED_CHUNKS]
            enc = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(enc.ids, "<u4")
            starts = np.fromiter((o[0] for o in enc.offsets), np.int64, len(ids))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            raw, last = ids.tobytes(), 0
            for cut in (np.searchsorted(starts, ends) * 4).tolist():
                out.append(raw[last:cut])
                last = cut
        return out

    def _encode_chunks(self, unseen: list[bytes]) -> dict[bytes, bytes]:
        texts = [c.decode("utf-8", "replace") for c in unseen]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        mixed = [k for k, t in enumerate(texts) if not t.isalpha()]
        found = dict(zip([unseen[k] for k in plain], self._encode_words([texts[k] for k in plain]), strict=True))
        found.update(zip([unseen[k] for k in mixed], self._encode_mixed([texts[k] for k in mixed]), strict=True))
        return found

    def encode(self, column, end_id: int | None = None):
        """(ids of all texts in a row, end of each text's ids) of an Arrow string column; each text ends with end_id."""
        import numpy as np

        words, distinct, ends = word_table(chunk_column(column))
        cache = self.cache
        trim(cache)
        keys = split_bytes(distinct)
        found = list(map(cache.get, keys))
        if unseen := [k for k, v in zip(keys, found, strict=True) if v is None]:
            fresh = self._encode_chunks(unseen)
            found = [fresh[k] if v is None else v for k, v in zip(keys, found, strict=True)]
            cache.update((k, v) for k, v in fresh.items() if len(k) <= CACHE_CHUNK_BYTES)
        if end_id is not None:
            words = np.insert(words, ends, len(found))
            ends = ends + np.arange(1, len(ends) + 1)
            found.append(np.array([end_id], "<u4").tobytes())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        own = sizes[words]
        last = np.cumsum(own)
        total = int(last[-1]) if len(last) else 0
        kind = np.int32 if max(total, len(pool)) < 1 << 30 else np.int64
        at = np.repeat((starts[words] - (last - own)).astype(kind), own)
        at += np.arange(total, dtype=kind)
        return pool.take(at), np.concatenate([[0], last])[ends]

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        import pyarrow as pa

        values, ends = self.encode(pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string()))
        ends = [0, *ends.tolist()]
        return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str) -> WordEncoder:
    """The worker process's encoder for this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def byte_column(column) -> list[bytes | None]:
    """An Arrow string column as bytes objects, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch, column: str, most_bytes: int = 4_000_000):
    """Cut a record batch so that each part holds about most_bytes of the text column, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end
