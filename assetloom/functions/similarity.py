"""String similarity on the 0-100 scale: whole-string ratio and best-window ratio.

Both are ``200 * LCS(a, b) / (len(a) + len(b))``, the normalised insert/delete
similarity over code points. The kernels score a batch of pairs at once with
the bit-parallel LCS recurrence, one 64-bit word per 64 characters of the
first string, so texts of any length are scored whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WORD = 64
MAX_WORDS = 8  # longer strings use one Python integer per pair
BLOCK_CELLS = 1 << 20
MATRIX_CELLS = 1 << 17  # words of a step of ``lcs_matrix``, few enough for a core's cache
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

# Character classes for the overlap bound: letters, digits and space alone, the rest folded.
CLASSES = 48


class Texts:
    """Texts as one code-point array with start and length per text."""

    def __init__(self, texts):
        self.n = len(texts)
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def reversed(self) -> Texts:
        other = Texts.__new__(Texts)
        other.n, other.lengths = self.n, self.lengths
        other.codes = self.codes[::-1]
        other.starts = len(self.codes) - self.starts - self.lengths
        return other

    def parts(self, ids: np.ndarray, length: int, last: bool = False) -> Texts:
        """The first (or last) ``length`` characters of each of these texts, which have as many."""
        other = Texts.__new__(Texts)
        starts = self.starts[ids] + (self.lengths[ids] - length if last else 0)
        other.n, other.lengths = len(ids), np.full(len(ids), length, np.int64)
        other.codes = self.codes[(starts[:, None] + np.arange(length)).ravel()]
        other.starts = np.arange(len(ids), dtype=np.int64) * length
        return other

    def chosen(self, ids: np.ndarray, lengths: np.ndarray | None = None, skip=0) -> Texts:
        """These texts alone, or of each only the given number of characters behind the first ``skip``."""
        other = Texts.__new__(Texts)
        other.n, other.lengths = len(ids), self.lengths[ids] if lengths is None else lengths
        other.starts = np.cumsum(other.lengths) - other.lengths
        place = np.repeat(self.starts[ids] + skip - other.starts, other.lengths)
        other.codes = self.codes[place + np.arange(len(place))]
        return other

    def code(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i] + self.lengths[i]]

    def class_counts(self) -> np.ndarray:
        """Occurrences of each character class per text."""
        c = self.codes.astype(np.int64)
        cls = 37 + c % (CLASSES - 37)
        letters, digits = (c >= 97) & (c <= 122), (c >= 48) & (c <= 57)
        cls[letters] = c[letters] - 97
        cls[digits] = 26 + c[digits] - 48
        cls[c == 32] = 36
        owner = np.repeat(np.arange(self.n), self.lengths)
        return np.bincount(owner * CLASSES + cls, minlength=self.n * CLASSES).reshape(self.n, CLASSES).astype(np.int32)


def codes_of(values) -> tuple[np.ndarray, list]:
    """Each value's number in order of first appearance, and the distinct values; any text is safe as a key."""
    seen: dict = {}
    numbers = np.fromiter((seen.setdefault(v, len(seen)) for v in values), dtype=np.int64, count=len(values))
    return numbers, list(seen)


def _bit_table(texts: Texts, ids: np.ndarray, words: int):
    """Per text and character, the bit mask of the character's places; last row is 'no such character'."""
    lengths = texts.lengths[ids]
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = texts.codes[np.repeat(texts.starts[ids], lengths) + place]
    alphabet, index = np.unique(codes, return_inverse=True)
    table = np.zeros((len(ids), len(alphabet) + 1, words), dtype=np.uint64)
    bits = np.uint64(1) << (place % WORD).astype(np.uint64)
    np.bitwise_or.at(table, (owner, index, place // WORD), bits)
    return alphabet, table


def _step(v: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One character of the LCS recurrence on word vectors of shape (pairs, words)."""
    u = v & mask
    if v.shape[1] == 1:
        return (v + u) | (v - u)
    out = np.empty_like(v)
    carry = np.zeros(len(v), dtype=np.uint64)
    for w in range(v.shape[1]):
        total = v[:, w] + u[:, w]
        over = total < u[:, w]
        total2 = total + carry
        carry = (over | (total2 < total)).astype(np.uint64)
        out[:, w] = total2 | (v[:, w] - u[:, w])
    return out


def _length_mask(lengths: np.ndarray, words: int) -> np.ndarray:
    left = np.clip(lengths[:, None] - WORD * np.arange(words)[None, :], 0, WORD)
    shift = np.minimum(WORD - left, WORD - 1).astype(np.uint64)
    return np.where(left == 0, np.uint64(0), ALL >> shift)


def _lcs_int(a: np.ndarray, b: np.ndarray) -> list[int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, lcs = full, [0]
    for c in b.tolist():
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        lcs.append(len(a) - v.bit_count())
    return lcs


def lcs_slices(a: Texts, ai: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, running: bool = False):
    """LCS of text ``ai`` of ``a`` with the code slice ``starts, lengths``, per pair.

    With ``running``, a row per pair instead: the LCS with the first 0, 1, 2, ... characters of the slice.
    """
    out = np.zeros((len(ai), int(lengths.max(initial=0)) + 1) if running else len(ai), dtype=np.int32 if running else np.int64)
    live = (a.lengths[ai] > 0) & (lengths > 0)
    words = np.maximum(1, -(-a.lengths[ai] // WORD))
    size = np.where(words > MAX_WORDS, 0, 1 << np.ceil(np.log2(words)).astype(np.int64))
    for w in np.unique(size[live]):
        rows = np.flatnonzero(live & (size == w))
        if w == 0:
            for r in rows:
                lcs = _lcs_int(a.code(ai[r]), codes[starts[r] : starts[r] + lengths[r]])
                if running:
                    out[r, : len(lcs)] = lcs
                else:
                    out[r] = lcs[-1]
            continue
        rows = rows[np.lexsort((-lengths[rows], ai[rows]))]
        step = max(1, BLOCK_CELLS // (4 * int(w)))
        for at in range(0, len(rows), step):
            block = rows[at : at + step]
            got = _lcs_block(a, ai[block], codes, starts[block], lengths[block], int(w), running)
            if running:
                out[block, : got.shape[1]] = got
            else:
                out[block] = got
    return out


def _lcs_block(a, ai, codes, starts, lengths, words, running):
    order = np.argsort(-lengths, kind="stable")
    ai, starts, lengths = ai[order], starts[order], lengths[order]
    ids, owner = np.unique(ai, return_inverse=True)
    alphabet, table = _bit_table(a, ids, words)
    missing = len(alphabet)
    lo = int(starts.min())
    window = codes[lo : int((starts + lengths).max())]
    spot = np.minimum(np.searchsorted(alphabet, window), missing - 1)
    index = np.where(alphabet[spot] == window, spot, missing)
    starts = starts - lo
    a_len = a.lengths[ai]
    keep = _length_mask(a_len, words)
    v = np.full((len(ai), words), ALL, dtype=np.uint64)
    every = np.zeros((int(lengths[0]) + 1, len(ai)), np.int32) if running else None
    # Slices are sorted by length, so the pairs still running are always a prefix.
    alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")
    table, row = table.reshape(-1, words), owner * (missing + 1)
    for j in range(int(lengths[0])):
        n = int(alive[j])
        mask = table.take(row[:n] + index.take(starts[:n] + j), axis=0)
        if words == 1:
            mask &= v[:n]
            np.bitwise_or(v[:n] + mask, v[:n] - mask, out=v[:n])
        else:
            v[:n] = _step(v[:n], mask)
        if running:
            every[j + 1, :n] = np.bitwise_count(~v[:n] & keep[:n]).sum(axis=1) if words > 1 else np.bitwise_count(~v[:n, 0] & keep[:n, 0])
    result = every.T if running else np.bitwise_count(~v & keep).sum(axis=1, dtype=np.int64)
    back = np.empty_like(result)
    back[order] = result
    return back


class WordTexts:
    """Texts of at most ``WORD`` characters, their places as the bits of one word a text."""

    def __init__(self, texts: Texts):
        self.n = texts.n
        self.word = np.uint32 if texts.lengths.max(initial=0) <= 32 else np.uint64
        self.alphabet, table = _bit_table(texts, np.arange(texts.n), 1)
        self.table = np.ascontiguousarray(table[:, :, 0].T.astype(self.word))
        self.keep = _length_mask(texts.lengths, 1)[:, 0].astype(self.word)

    def lcs_bits(self, a: Texts, ids: np.ndarray) -> np.ndarray:
        """For every text ``ids`` of ``a`` and every one of these, a word with as many of its first j bits set as the LCS with
        the first j characters has.

        A step takes a character of ``a`` against all texts, and what texts of ``a`` have in common at their beginning is
        stepped through once.
        """
        out = np.zeros((len(ids), self.n), self.word)
        lengths = a.lengths[ids]
        if not len(self.alphabet) or not lengths.sum():
            return out
        # Characters that none of these texts has change nothing; the others stand at the left of their row.
        owner = np.repeat(np.arange(len(ids)), lengths)
        codes = a.codes[np.repeat(a.starts[ids] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(owner))]
        spot = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        known = self.alphabet[spot] == codes
        owner, spot = owner[known], spot[known]
        size = np.bincount(owner, minlength=len(ids))
        rows = np.full((len(ids), max(1, int(size.max()))), -1, np.int32)
        rows[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = spot
        order = np.lexsort(rows.T[::-1])
        step = max(1, MATRIX_CELLS // self.n)
        for at in range(0, len(ids), step):
            block = order[at : at + step]
            part, left = rows[block], size[block]
            differs = part[1:] != part[:-1]
            shared = np.concatenate([[-1], np.where(differs.any(axis=1), differs.argmax(axis=1), part.shape[1])])
            v, node = np.full((1, self.n), ALL.astype(self.word), self.word), np.zeros(len(block), np.int64)
            for depth in range(int(left.max()) + 1):
                ended = np.flatnonzero(left == depth)
                out[block[ended]] = ~v[node[ended]] & self.keep
                going = np.flatnonzero(left > depth)
                if not len(going):
                    break
                fresh = shared[going] <= depth
                first = going[fresh]
                if len(first) > 1 or len(v) > 1:
                    v = v.take(node[first], axis=0)
                mask = self.table.take(part[first, depth], axis=0)
                mask &= v
                total = v + mask
                v -= mask
                v |= total
                node[going] = np.cumsum(fresh) - 1
        return out


def ratio_pairs(a: Texts, b: Texts, ai: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Whole-string ratio per pair; two empty strings score 100."""
    total = a.lengths[ai] + b.lengths[bi]
    lcs = lcs_slices(a, ai, b.codes, b.starts[bi], b.lengths[bi])
    return np.where(total == 0, 100.0, 200.0 * lcs / np.maximum(total, 1))


def _partial_short(short: Texts, long: Texts, si: np.ndarray, li: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Best window of ``long`` (at least as long as ``short``): every full window, shorter prefixes and suffixes."""
    best = np.zeros(len(si))
    r_short, r_long = short.reversed(), long.reversed()
    step = max(1, BLOCK_CELLS // (int(long.lengths[li].max(initial=0)) + 1))
    for at in range(0, len(si), step):
        block = slice(at, at + step)
        s, t = si[block], li[block]
        heads = lcs_slices(short, s, long.codes, long.starts[t], long.lengths[t], running=True)
        tails = lcs_slices(r_short, s, r_long.codes, r_long.starts[t], long.lengths[t], running=True)
        pair = np.arange(len(s))
        best[block] = _windows(short, long, s, t, lambda j: heads[pair, j], lambda j: tails[pair, j], bar[block])
    return best


def _windows(short, long, si, li, head, tail, bar) -> np.ndarray:
    """``_partial_short`` where ``head(j)`` is the LCS of ``short`` and the first j characters of ``long``, ``tail(j)`` that of its last j.

    A full window shares no more than the lesser of the two that hold it, so only windows are tried that may be the best of
    their pair and reach its ``bar``; shorter ones that are too short for that are left out.
    """
    m, n = short.lengths[si], long.lengths[li]
    top = np.zeros(len(si))
    least = np.maximum(np.ceil(bar * m / np.maximum(200.0 - bar, 1.0) - 1e-6), 1).astype(np.int64)
    for missing in range(int((m - least).max(initial=-1)) + 1):
        size = np.maximum(m - missing, 0)
        lcs = np.maximum(head(size), tail(size)).astype(np.int64)
        np.maximum(top, 200.0 * lcs / (m + size), out=top)
    shifts = int((n - m).max(initial=0)) - 1
    if shifts > 0:
        bound = np.zeros((shifts, len(si)), np.uint8 if m.max() < 256 else np.int32)
        for k in range(shifts):
            inner = k + 1 < n - m
            bound[k] = np.where(inner, np.minimum(head(np.minimum(m + k + 1, n)), tail(np.maximum(n - k - 1, 0))), 0)
        likely = bound.argmax(axis=0), np.arange(len(si))
        for tried in (0, 1):
            if tried:
                bound[likely] = 0
                need = np.clip(np.ceil(np.maximum(top, bar) * m / 100.0 - 1e-6), 1, m).astype(bound.dtype)
                col, pair = np.nonzero(bound >= need)
            else:
                col, pair = likely
            most = 100.0 * bound[col, pair] / m[pair]
            go = (most > top[pair]) & (most >= bar[pair])
            col, pair = col[go], pair[go]
            if len(pair):
                lcs = lcs_slices(short, si[pair], long.codes, long.starts[li[pair]] + col + 1, m[pair])
                np.maximum.at(top, pair, 100.0 * lcs / m[pair])
    return top


def partial_pairs(a: Texts, b: Texts, ai: np.ndarray, bi: np.ndarray, bar: np.ndarray | None = None) -> np.ndarray:
    """Best-window ratio per pair; equal lengths are tried both ways round; one empty string scores 0.

    With ``bar``, pairs that do not reach theirs may come with less than their score.
    """
    la, lb = a.lengths[ai], b.lengths[bi]
    out = np.where((la == 0) & (lb == 0), 100.0, 0.0)
    bar = np.zeros(len(ai)) if bar is None else bar
    for rows, swap in ((np.flatnonzero((la <= lb) & (la > 0)), False), (np.flatnonzero((lb <= la) & (lb > 0)), True)):
        if len(rows):
            args = (b, a, bi[rows], ai[rows]) if swap else (a, b, ai[rows], bi[rows])
            out[rows] = np.maximum(out[rows], _partial_short(*args, bar[rows]))
    return out


SCORERS = {"ratio": ratio_pairs, "partial": partial_pairs}


def score_bound(scorer: str, overlap, a_len, b_min, b_max):
    """The highest score a text can reach with strings of ``b_min..b_max`` characters.

    ``overlap`` is the most characters the two sides can have in common.
    """
    overlap = np.minimum(overlap, np.minimum(a_len, b_max))
    if scorer == "ratio":
        b_len = np.clip(overlap, b_min, b_max)
        total = a_len + b_len
        return np.where(total == 0, 100.0, 200.0 * overlap / np.maximum(total, 1))
    short = np.minimum(a_len, b_min)
    return np.where(overlap >= short, 100.0, 200.0 * overlap / np.maximum(short + overlap, 1))


def window_bounds(overlap, a: Texts, ids: np.ndarray, a_counts: np.ndarray, b: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The highest best-window score of each text ``ids`` of ``a`` with each of ``b``: by windows as long as ``a``, and by shorter ones.

    Only windows at an end of ``b`` are shorter than ``a``, and they share no more with ``a`` than that end does, so this is
    closer than ``score_bound``. Where ``b`` is no longer than ``a``, the second is ``score_bound`` and the first 0.
    """
    lengths = a.lengths[ids]
    whole, ends = np.zeros(overlap.shape), score_bound("partial", overlap, lengths[:, None], b.lengths, b.lengths)
    for m in np.unique(lengths[lengths > 0]):
        rows, cols = np.flatnonzero(lengths == m), np.flatnonzero(b.lengths > m)
        if not len(cols):
            continue
        at = np.ix_(rows, cols)
        whole[at] = 100.0 * overlap[at] / m
        shared = np.zeros((len(rows), len(cols)), np.int32)
        for last in (False, True):
            np.maximum(shared, overlap_matrix(a_counts[rows], b.parts(cols, m - 1, last).class_counts()), out=shared)
        ends[at] = 200.0 * shared / (m + np.maximum(shared, 1))
    return whole, ends


class Windows:
    """Best-window scores against the texts of ``b``, where they fit a word by the LCS with all their beginnings and ends at once."""

    def __init__(self, b: Texts):
        self.b, self.counts = b, b.class_counts()
        self.fits = b.lengths <= WORD
        self.short, self.long = np.flatnonzero(self.fits), np.flatnonzero(~self.fits)
        words = b.chosen(self.short)
        self.place = np.cumsum(self.fits) - 1
        self.heads, self.tails = WordTexts(words), WordTexts(words.reversed())

    def ask(self, a: Texts, ids: np.ndarray) -> None:
        """Take texts ``ids`` of ``a``, which the other methods name by their place there.

        A window as long as the text shares no more with it than the whole target does (``most``); a shorter one lies at an end
        of the target, and that end shares no less (``ends``). Where the target is no longer, its windows are those of the text.
        """
        self.a, self.ids, self.m = a, ids, a.lengths[ids]
        self.head_bits, self.tail_bits = self.heads.lcs_bits(a, ids), self.tails.lcs_bits(a.reversed(), ids)
        low = _length_mask(np.clip(self.m - 1, 0, WORD), 1).astype(self.heads.word)
        whole = np.bitwise_count(self.head_bits)
        ends = np.maximum(np.bitwise_count(self.head_bits & low), np.bitwise_count(self.tail_bits & low))
        if len(self.long):
            shape = len(ids), self.b.n
            self.most, self.ends = np.empty(shape, np.int32), np.empty(shape, np.int32)
            self.most[:, self.short], self.ends[:, self.short] = whole, ends
            self.most[:, self.long] = self.ends[:, self.long] = overlap_matrix(a.chosen(ids).class_counts(), self.counts[self.long])
        else:
            self.most, self.ends = whole, ends

    def bound(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores that these pairs do not exceed."""
        most, ends = self.most[rows, cols].astype(np.int64), self.ends[rows, cols].astype(np.int64)
        m, n = self.m[rows], self.b.lengths[cols]
        shorter, longer = np.minimum(m, n), n > m
        ends = np.where(longer, np.minimum(ends, m - 1), most)
        value = np.where(longer, 100.0 * most / np.maximum(m, 1), 0.0)
        value = np.minimum(np.maximum(value, 200.0 * ends / np.maximum(shorter + ends, 1)), 100.0)
        value[~longer & (most >= shorter)] = 100.0
        return np.where(shorter == 0, 100.0 * (m == n), value)

    def reaching(self, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, by text and target, whose bound may reach the ``bar`` of the text."""
        need = np.ceil(bar * self.m / 100.0 - 1e-6)
        need_ends = np.ceil(bar * self.m / np.maximum(200.0 - bar, 1.0) - 1e-6)
        top = np.iinfo(self.most.dtype).max
        need, need_ends = (np.clip(x, 0, top).astype(self.most.dtype)[:, None] for x in (need, need_ends))
        return np.nonzero((self.most >= need) | (self.ends >= need_ends) | (self.b.lengths <= self.m[:, None]))

    def scores(self, rows: np.ndarray, cols: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """Scores of the texts asked for, by their place there; pairs that do not reach their ``bar`` may come with less."""
        ai = self.ids[rows]
        quick = self.fits[cols] & (self.b.lengths[cols] > self.a.lengths[ai]) & (self.a.lengths[ai] > 0)
        out = np.empty(len(rows))
        other = np.flatnonzero(~quick)
        out[other] = partial_pairs(self.a, self.b, ai[other], cols[other], bar[other])
        quick = np.flatnonzero(quick)
        low = _length_mask(np.arange(WORD + 1), 1)[:, 0].astype(self.heads.word)
        for at in range(0, len(quick), MATRIX_CELLS // 8):
            pair = quick[at : at + MATRIX_CELLS // 8]
            place = rows[pair], self.place[cols[pair]]
            begin, end = self.head_bits[place], self.tail_bits[place]
            head, tail = (lambda j: np.bitwise_count(begin & low[j])), (lambda j: np.bitwise_count(end & low[j]))
            out[pair] = _windows(self.a, self.b, ai[pair], cols[pair], head, tail, bar[pair])
        return out


def overlap_matrix(a_counts: np.ndarray, b_counts: np.ndarray) -> np.ndarray:
    """Sum over classes of the smaller count, for every row of ``a`` against every row of ``b``."""
    if len(a_counts) and a_counts.sum(axis=1).max() < 256:  # no sum is larger, and small numbers are added faster
        a_counts, b_counts = a_counts.astype(np.uint8), np.minimum(b_counts, 255).astype(np.uint8)
    out = np.zeros((len(a_counts), len(b_counts)), dtype=a_counts.dtype)
    for c in range(a_counts.shape[1]):
        col = a_counts[:, c]
        rows = np.flatnonzero(col)
        if len(rows) and b_counts[:, c].any():
            if len(rows) == len(out):
                out += np.minimum(col[:, None], b_counts[None, :, c])
            else:
                out[rows] += np.minimum(col[rows, None], b_counts[None, :, c])
    return out.astype(np.int32)


def _pair_udf(scorer: str):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        known = (a.notna() & b.notna()).to_numpy()
        if known.any():
            (ac, au), (bc, bu) = codes_of(a[known]), codes_of(b[known])
            out[known] = SCORERS[scorer](Texts(au), Texts(bu), ac, bc)
        return out.astype(object).where(known, None)

    return score


def ratio(a, b):
    """Whole-string similarity of two columns."""
    return _pair_udf("ratio")(a, b)


def partial_ratio(a, b):
    """Best-window similarity of two columns."""
    return _pair_udf("partial")(a, b)
