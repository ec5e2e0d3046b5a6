"""Helpers that several operators use: shared scratch space, ordered ranges, token ids."""

from __future__ import annotations

import functools
import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, written  # noqa: F401  (operators take them from here)
from ..scratch import path as scratch_path  # noqa: F401

#: A word of every operator on words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- tables and partitions
def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable, rows: int = 500) -> Iterator:
    """The rows of Arrow batches in smaller ones, so that what a task turns into Python objects at a time stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# ---------------------------------------------------------------- global order
def range_cuts(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` ascending values that cut ``key`` into ranges of about equal row counts.

    One aggregation with a mergeable quantile summary; the driver gets ``parts``
    numbers, never keys in proportion to the rows.
    """
    if parts < 2:
        return []
    probabilities = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, probabilities, 20 * parts).alias("cuts")).first()
    return sorted(set(row.cuts or []))


def range_of(key: Column, cuts: list) -> Column:
    """Number of the range (from 0) a value falls into; equal values share a range.

    Cuts lie in blocks of about the square root of their number: a row is compared with each block's first cut, then inside one block.
    """
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    block = below(F.array(*[F.lit(b[0]) for b in blocks]))
    inside = below(F.element_at(F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks]), block))
    return F.when(block > 0, (block - 1) * size + inside).otherwise(0)


def in_order(df: DataFrame, key: str, place: str) -> DataFrame:
    """``df`` with the place (from 0) of each row by ``key``, which no two rows share.

    Rows are sorted in ranges and written; the driver gets the number of rows of each range, of which there are as many as shuffle partitions.
    """
    at, part = free_names(df, "at", "part")
    ranged = written(df.orderBy(key).withColumn(at, F.monotonically_increasing_id()), "ordered")
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(F.shiftright(at, 33)).agg(F.max(inside) + 1).collect())
    before = list(itertools.accumulate((n for _, n in counts), initial=0))
    starts = df.sparkSession.createDataFrame([(int(p), int(n)) for (p, _), n in zip(counts, before)], f"{part} long, {place} long")
    return ranged.join(F.broadcast(starts), F.shiftright(at, 33) == F.col(part)).withColumn(place, F.col(place) + inside).drop(at, part)


# ---------------------------------------------------------------- hot keys
#: A key is hot with more than one in so many of all rows; so there are fewer hot keys than this.
HOT_KEYS = 10_000
#: Bytes of table rows that may be broadcast; hot keys with more are dealt to so many tasks each instead.
BROADCAST_BYTES, SALTS = 64 << 20, 64


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    size = {"string": F.octet_length, "binary": F.octet_length, "array<string>": lambda c: F.octet_length(F.array_join(c, " ")) + 16 * F.size(c)}
    parts = [F.coalesce(size[kind](F.col(name)), F.lit(0)).cast("long") for name, kind in df.dtypes if kind in size]
    return functools.reduce(lambda x, y: x + y, parts, F.lit(16 * len(df.columns)).cast("long"))


def join_hot(rows: DataFrame, table: DataFrame, on: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which has one row per key and, in column ``count``, about how many of ``rows`` have it.

    The rows of a hot key stay where they are and meet its one table row by broadcast: fewer than HOT_KEYS rows, which are measured
    and in all at most BROADCAST_BYTES.  If they are more, a hot key's row is copied to SALTS keys and its rows are dealt to them; then only the keys
    themselves are broadcast.  The rest is shuffled, and no key of it is more than a small part of a task.
    Both tables are read twice, so they are written ones.
    """
    total, largest = table.agg(F.sum(count), F.max(_row_bytes(table))).first()
    is_hot = F.col(count) * HOT_KEYS > (total or 0)
    hot, keys = table.where(is_hot).drop(count), F.broadcast(table.where(is_hot).select(*on))
    # only rows so large that the number of keys does not bound them have to be added up
    if (largest or 0) * HOT_KEYS <= BROADCAST_BYTES or (hot.agg(F.sum(_row_bytes(hot))).first()[0] or 0) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(hot), [*on])
    else:
        (salt,) = free_names(rows, "salt")
        plain = [c for c, kind in rows.dtypes if not kind.startswith("map")]
        dealt = rows.join(keys, [*on], "left_semi").withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
        met = dealt.join(hot.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, salt]).drop(salt)
    rest = rows.join(keys, [*on], "left_anti").join(table.where(~is_hot).drop(count), [*on], how)
    return met.unionByName(rest.select(met.columns))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- hashes of runs
def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4)
def _factors(size: int, which: int) -> np.ndarray:
    """A 64-bit factor for each place of a run, odd and without a pattern."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(which)) | np.uint64(1)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, twice: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """One 64-bit hash, or two, of each run ``codes[start:end]``; runs ascend and do not overlap.

    Each code is multiplied by a factor of its place in its run, and a run's hash is the sum (multilinear hashing).  The factors are
    as random, so unlike for the powers of one base no family of texts is known that meets in it.
    """
    n = len(codes)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64) if twice else None
    lengths = np.diff(starts, append=n)
    place = np.zeros(n, np.int64)
    place[starts[0] :] = np.arange(starts[0], n)
    place[starts[0] :] -= np.repeat(starts, lengths)
    size = 1 << max(10, int(lengths.max()).bit_length())
    values, sums, out = codes.astype(np.uint64) + np.uint64(1), np.zeros(n + 1, np.uint64), []
    for which in range(1 + twice):
        x = _factors(size, which)[place]
        x *= values
        np.cumsum(x, out=sums[1:])
        out.append(sums[ends] - sums[starts])
    return out[0], out[1] if twice else None


# ---------------------------------------------------------------- tokenizers
# Letters of the fast path, and the contractions that the two public files know.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = f"\\x00-\\x1b\\x20-\\x7f{LATIN}–—‘-„…"
CONTRACTION = {False: re.compile("'(?:s|t|re|ve|m|ll|d)"), True: re.compile("'(?:s|t|re|ve|m|ll|d)", re.I)}
#: Stands between new pre-tokens; no text of the fast path has it.
BETWEEN, TOGETHER = "\x1f", 500
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE = range(5)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the fast path; 0 is the gap between texts."""
    kinds = np.full(0x2100, _MARK, np.uint8)
    for i in range(0x250):
        c = chr(i)
        kinds[i] = _LETTER if c.isalpha() and re.match(f"[{LATIN}]", c) else _DIGIT if "0" <= c <= "9" else _SPACE if c.isspace() else _MARK
    return kinds


@functools.cache
def _odd() -> np.ndarray:
    """Whether a code point is none of the fast path; the last place stands for all beyond."""
    odd = re.compile(f"[^{PLAIN}]")
    return np.array([bool(odd.match(chr(i))) for i in range(0x2100)])


@functools.cache
def _byte_letters() -> np.ndarray:
    """The letter that the library's byte-level pre-tokenizer writes for each byte that the fast path has."""
    from tokenizers import pre_tokenizers

    every = "".join(map(chr, range(0x2100)))
    [(written, _)] = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every)
    letters = np.zeros(256, "<u2")
    letters[np.frombuffer(every.encode(), np.uint8)] = np.frombuffer(written.encode("utf-16-le"), "<u2")
    return letters


def _codes(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts with a gap after each, their code points and the gaps' places."""
    text = "\0".join(texts) + "\0"
    return text, np.frombuffer(text.encode("utf-32-le"), "<u4"), np.cumsum([len(x) + 1 for x in texts]) - 1


class _Table:
    """Sorted 64-bit keys, each with 64 bits more to know it by and the ids it stands for, in a few flat arrays."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.checks, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ascending ``keys``, which of them are there, and whose place another one has."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        near, same = self.keys[at] == keys, self.checks[at] == checks
        return at, near & same, near & ~same

    def add_table(self, other: _Table) -> None:
        self.add(other.keys, other.checks, other.lengths, other.ids[: other.used], other.starts)

    def add(self, keys: np.ndarray, checks: np.ndarray, lengths: np.ndarray, ids: np.ndarray, starts: np.ndarray | None = None) -> None:
        """Ascending new keys, their checks, numbers of ids and the ids, which lie at ``starts`` or one after the other."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")  # two ascending runs, so a merge
        self.keys = every[order]
        self.checks = np.concatenate([self.checks, checks])[order]
        places = self.used + (np.cumsum(lengths) - lengths if starts is None else starts)
        self.starts = np.concatenate([self.starts, places.astype(np.int32)])[order]
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])[order]
        self.used += len(ids)


class PieceEncoder:
    """Encodes texts with a tokenizer file of the ``tokenizers`` library, pre-token by pre-token.

    Both public files cut a text into pre-tokens and merge inside each of them, so the ids of a
    text are those of its pre-tokens in turn.  The cut is found for a group of texts in array
    passes; the library encodes each distinct pre-token, and a bounded table keeps what it said
    by two independent 64-bit hashes.  A text with letters beyond the Latin ranges, with white space in a row or with
    an added token of the file, or a file with another pre-tokenizer, goes to the library whole.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        kinds = [x["type"] for x in (shape["pre_tokenizer"] or {}).get("pretokenizers", [])] or [(shape["pre_tokenizer"] or {}).get("type")]
        #: Whether white space is dropped and case folded (words), or a space belongs to what follows (bytes).
        self.words = {("ByteLevel",): False, ("Split", "ByteLevel"): True}.get(tuple(kinds))
        self.lower = "Lowercase" in str(shape["normalizer"])
        added = [x["content"] for x in shape.get("added_tokens") or []]
        #: What an added token looks like in a text; the library knows it as one id.
        self.added = [x.lower() for x in added] if self.lower else added
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if self.words is not None:
            #: The same model, held once, for pre-tokens in its byte letters, with that of BETWEEN after each.
            self.single, between = Tokenizer(self.tokenizer.model), chr(_byte_letters()[ord(BETWEEN)])
            self.single.pre_tokenizer = pre_tokenizers.Split(between, "isolated")
            made = self.single.encode(between, add_special_tokens=False)
            if len(made.ids) == 1 and made.tokens[0].startswith(between):
                self.between = made.ids[0]
            else:  # nothing would tell new pre-tokens apart
                self.words = None
        #: Ids of known pre-tokens; the newest are in a small table of their own, merged now and then.
        self.most, self.known, self.newest = most, _Table(self.dtype), _Table(self.dtype)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None], most_chars: int = 500_000) -> Iterator[np.ndarray]:
        """The ids of each text, null being empty."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= most_chars:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = self._whole(texts)
        plain = [i for i in range(len(texts)) if i not in whole]
        found = dict(zip(plain, self._encode_plain([texts[i].lower() if self.lower else texts[i] for i in plain]))) if plain else {}
        for i, x in enumerate(texts):
            yield found[i] if i in found else np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.dtype)

    def _whole(self, texts: list[str]) -> set[int]:
        """Which texts the library encodes whole."""
        if self.words is None or not texts:
            return {*range(len(texts))}
        text, codes, gaps = _codes(texts)
        codes = np.minimum(codes, 0x20FF)
        odd = _odd()[codes]
        if not self.words:
            space = _kinds()[codes] == _SPACE
            odd[1:] |= space[1:] & space[:-1]
        whole = set(np.searchsorted(gaps, np.flatnonzero(odd)).tolist())
        fold = str.lower if self.lower else str
        if any(a in fold(text) for a in self.added):
            whole |= {i for i, x in enumerate(texts) if any(a in fold(x) for a in self.added)}
        return whole

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has and all their ids, from the library; it gets many in one text, as each text has a price."""
        texts = []
        for i in range(0, len(pieces), TOGETHER):
            data = (BETWEEN.join(pieces[i : i + TOGETHER]) + BETWEEN).encode()
            texts.append(_byte_letters()[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le"))
        made = [np.array(x.ids, np.uint32) for x in self.single.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(made)
        ends = np.flatnonzero(ids == self.between)
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends).astype(self.dtype)

    def _pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts with a gap after each, their code points, where pre-tokens start and end, and the gaps' places."""
        text, codes, gaps = _codes(texts)
        kinds = _kinds()[np.minimum(codes, 0x20FF)]
        kinds[gaps] = _OTHER
        before = np.r_[np.uint8(_OTHER), kinds[:-1]]
        start = kinds != before
        if self.words:
            start |= kinds == _DIGIT
            start[kinds == _SPACE] = False
            nothing = (kinds == _SPACE) | (kinds == _OTHER)
        else:
            # a space opens the pre-token that follows; any other white space stands alone
            after_space = np.r_[False, codes[:-1] == 32] & (before == _SPACE) & (kinds != _OTHER)
            start[after_space] = False
            nothing = kinds == _OTHER
        start[gaps] = False
        if "'" in text:
            for m in CONTRACTION[self.words].finditer(text):
                i = m.start()
                if before[i] != _MARK and (self.words or i == 0 or codes[i - 1] != 32 or before[i] != _SPACE):
                    start[i + 1 : m.end()] = False
                    start[m.end()] = not nothing[m.end()] and (self.words or kinds[m.end()] != _OTHER)
        at = np.flatnonzero(start | nothing)
        real = start[at]
        return text, codes, at[real], np.r_[at[1:], len(codes)][real], gaps

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        text, codes, starts, ends, gaps = self._pieces(texts)
        keys, checks = run_hashes(codes, starts, ends, twice=True)
        order = np.argsort(keys)
        differ = keys[order][1:] != keys[order][:-1]
        if (~differ & (checks[order][1:] != checks[order][:-1])).any():
            order = np.lexsort((checks, keys))
            differ = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
        first = np.flatnonzero(np.r_[True, differ]) if len(keys) else np.zeros(0, np.int64)
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
        example = order[first]
        distinct, marks = keys[example], checks[example]
        lengths, offsets = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        (at, old, other), (near, new, another) = self.known.find(distinct, marks), self.newest.find(distinct, marks)
        for table, place, hit, base in ((self.known, at, old, 0), (self.newest, near, new, self.known.used)):
            lengths[hit], offsets[hit] = table.lengths[place[hit]], table.starts[place[hit]].astype(np.int64) + base
        flat = [self.known.ids[: self.known.used], self.newest.ids[: self.newest.used]]
        if len(missing := np.flatnonzero(~(old | new))):
            spans = zip(starts[example[missing]].tolist(), ends[example[missing]].tolist())
            own, made = self._encode_new([text[a:b] for a, b in spans])
            lengths[missing] = own
            offsets[missing] = self.known.used + self.newest.used + np.cumsum(own) - own
            flat.append(made)
        # a copy of what this group needs: the tables change below
        need = np.cumsum(lengths) - lengths
        picked = np.repeat(offsets - need, lengths) + np.arange(int(lengths.sum()))
        edges = np.cumsum([0, *map(len, flat)])
        ids = np.empty(len(picked), self.dtype)
        for part, low, high in zip(flat, edges[:-1], edges[1:]):
            here = (picked >= low) & (picked < high)
            ids[here] = part[picked[here] - low]
        if len(missing):
            # of two pre-tokens of one key only the first is kept; the library encodes the other each time
            kept = ~(other | another)[missing] & np.r_[True, distinct[missing][1:] != distinct[missing][:-1]]
            self.newest.add(distinct[missing][kept], marks[missing][kept], own[kept], flat[2][np.repeat(kept, own)])
            if len(self.newest.keys) * 8 > len(self.known.keys):
                if len(self.known.keys) + len(self.newest.keys) > self.most:
                    self.known = _Table(self.dtype)
                self.known.add_table(self.newest)
                self.newest = _Table(self.dtype)
        flat, offsets = ids, need
        own = lengths[group]
        stops = np.cumsum(own)
        out = flat[np.repeat(offsets[group] - stops + own, own) + np.arange(stops[-1] if len(stops) else 0)]
        pieces = np.searchsorted(starts, gaps)
        return np.split(out, np.r_[0, stops][pieces[:-1]])


#: An odd base of the hashes of pre-tokens and its inverse modulo 2^64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(2)
def _long_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    return _long_powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


@functools.lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and Python worker."""
    return PieceEncoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
