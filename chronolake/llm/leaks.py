"""Pages that hold passages of held-out test items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.letters import letters
from chronolake.llm.sentences import _edges, column_order, edge_columns
from chronolake.session import spread

#: Letters of the shortest match that counts, in alphabetic scripts and in scripts of syllables and ideographs; no more
#: than the least stretch of a short item.
SEED, SEED_WIDE = 9, 5
#: A page holds an item from this share of its letters on; a little is left for misread letters at either end.
SHARE, SLACK = 1 / 3, 0.013
#: The least score of a chain of matches, as a share of the item's letters, before and after its ends are followed on.
CHAIN, SCORE = 0.1, 0.2
#: What a step between matches costs at least, near by and far off their diagonal, and what is near, in units.
NEAR_STEP, FAR_STEP, NEAR = 1, 8, 25
#: What each letter of the item between two matches costs, and each that the page alone goes on.
MISSING, PASSED = 0.25, 0.004
#: A stretch runs on over so many letters of the item that the page lacks (a few words), in units; matches at a far step
#: may overlap by so many.
HOLE, OVERLAP = 45, 8
#: Pairs with up to so many matches are chained many at a time.
WIDTH = 512
#: For pairs with up to so many matches, on pages and in items of fewer letters, no step is followed before a simpler one
#: has shown what a chain can score at most; so many places are looked at together.
CEILED, CEILED_LETTERS, CELLS = 2048, 1 << 20, 1 << 15
#: Letters of test items in a block, and how many blocks each shard of pages is searched for in one pass.
BLOCK_LETTERS, BLOCKS = 1_000_000, 8
#: Characters of pages whose suffixes form one array, and how far the parts of a longer page overlap.
SHARD_CHARS, JOINT = 2_000_000, 256
#: Occurrences of test suffixes that are looked at together.
AT_ONCE = 1_000_000


def _wide(x: np.ndarray) -> np.ndarray:
    return ((x >= 0x3040) & (x < 0xA000)) | ((x >= 0xAC00) & (x < 0xD7B0)) | (x >= 0x20000)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and which range each belongs to."""
    n = high - low
    owner = np.repeat(np.arange(len(low)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


class Items:
    """A block of test items: their letters, and the suffixes that are long enough to match."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.flat, self.at = letters(texts)
        self.ids, self.sizes = np.asarray(ids, np.int64), np.diff(self.at)
        wide = np.r_[0, np.cumsum(_wide(self.flat))]
        self.is_wide = wide[self.at[1:]] - wide[self.at[:-1]] > self.sizes / 2
        least = np.ceil((SHARE - SLACK) * self.sizes).astype(np.int64)
        self.seeds = np.minimum(np.where(self.is_wide, SEED_WIDE, SEED), least)
        item = np.repeat(np.arange(len(ids)), self.sizes)
        place = np.arange(len(self.flat)) - self.at[item]
        self.suffixes = np.flatnonzero(place + self.seeds[item] <= self.sizes[item])
        self.item, self.place = item[self.suffixes], place[self.suffixes]


def _packed(code: np.ndarray, bits: int) -> np.ndarray:
    """At each place the letters from there on, packed in order, so that packed values sort as the letters do."""
    per, out = 64 // bits, np.zeros(len(code), np.uint64)
    long = np.r_[code.astype(np.uint64), np.zeros(per, np.uint64)]
    for j in range(per):
        out |= long[j : j + len(code)] << np.uint64(bits * (per - 1 - j))
    return out


class SuffixArray:
    """The suffix array of a shard of pages, and the search of test suffixes in it.

    Letters are coded over the shard's own alphabet, 0 parts the pages; a suffix ends with its page. Suffixes are sorted
    by as many letters as fit a word, then by doubling: those still equal are sorted by the ranks of what follows.
    """

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        pages = len(at) - 1
        there = np.zeros(int(flat.max(initial=0)) + 1, bool)
        there[flat] = True
        self.alphabet = np.flatnonzero(there).astype(flat.dtype)
        self.bits = max(4, int(len(self.alphabet) + 1).bit_length())
        self.per = 64 // self.bits
        own = np.repeat(np.arange(pages), np.diff(at))
        code = np.zeros(len(flat) + pages + 1, np.uint32)  # a 0 in front and one behind each page
        code[np.arange(len(flat)) + own + 1] = np.cumsum(there, dtype=np.uint32)[flat]
        self.code, self.starts = code, at[:-1] + np.arange(pages) + 1
        self.page = np.repeat(np.arange(-1, pages, dtype=np.int32), np.diff(np.r_[0, self.starts, len(code)]))
        key = _packed(code, self.bits)
        self.key = np.r_[key, np.zeros(self.per + 1, np.uint64)]
        self.array = self._sorted(key, np.r_[self.starts[1:] - 1, len(code) - 1] if pages else np.zeros(0, np.int64), own)
        self.first = key[self.array]

    def _sorted(self, key: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
        n, left = len(key), np.zeros(len(key), np.int32)  # letters up to the page's end
        place = np.arange(len(own)) + own + 1
        left[place] = ends[own] - place
        array = np.argsort(key)
        k = key[array]
        new = np.r_[True, k[1:] != k[:-1]]
        starts = np.flatnonzero(new)
        rank = np.empty(n, np.int32)
        rank[array] = np.repeat(starts, np.diff(np.r_[starts, n]))
        known = self.per
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]) & (left[array] >= known))
        while len(tied):
            i = array[tied]
            both = (rank[i].astype(np.int64) << 32) | rank[i + known]
            order = np.argsort(both)
            i, both = i[order], both[order]
            array[tied] = i
            new = np.r_[True, both[1:] != both[:-1]]
            starts = np.flatnonzero(new)
            rank[i] = np.repeat(tied[starts], np.diff(np.r_[starts, len(i)]))
            known *= 2
            tied = tied[~(new & np.r_[new[1:], True]) & (left[i] >= known)]
        return array

    def coded(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """The items' letters over this alphabet, with one that no page has for any other and behind each item, and packed."""
        none = len(self.alphabet) + 1
        code = np.full(len(items.flat) + len(items.sizes) + self.per, none, np.uint32)
        if len(items.flat) and len(self.alphabet):
            i = np.minimum(np.searchsorted(self.alphabet, items.flat), len(self.alphabet) - 1)
            own = np.repeat(np.arange(len(items.sizes)), items.sizes)
            code[np.arange(len(items.flat)) + own] = np.where(self.alphabet[i] == items.flat, i + 1, none)
        return code, _packed(code, self.bits)

    def interval(self, key: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search the range of the array in which suffixes share their first ``depth`` letters with those of ``key`` at ``at``."""
        shift = (self.bits * np.maximum(0, self.per - depth)).astype(np.uint64)
        want = key[at] >> shift
        low = np.searchsorted(self.first, want << shift, "left")
        high = np.searchsorted(self.first, (want << shift) | ((np.uint64(1) << shift) - np.uint64(1)), "right")
        known = self.per
        while True:
            open_ = np.flatnonzero((depth > known) & (high > low))
            if not len(open_):
                return low, high
            shift = (self.bits * np.maximum(0, self.per - (depth[open_] - known))).astype(np.uint64)
            want = key[at[open_] + known] >> shift
            a, b = low[open_], high[open_]
            low[open_], high[open_] = self._bisect(a, b, want, shift, known, False), self._bisect(a, b, want, shift, known, True)
            known += self.per

    def _bisect(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, shift: np.ndarray, skip: int, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        going = np.flatnonzero(low < high)
        while len(going):
            mid = (low[going] + high[going]) >> 1
            got = self.key[self.array[mid] + skip] >> shift[going]
            less = got <= want[going] if after else got < want[going]
            low[going], high[going] = np.where(less, mid + 1, low[going]), np.where(less, high[going], mid)
            going = going[low[going] < high[going]]
        return low

    def matches(self, items: Items) -> tuple[np.ndarray, ...]:
        """Longest verbatim matches of the items' suffixes: page, item, place in page, place in item, length.

        Every test suffix is searched for by its seed's letters; all its occurrences are extended to the longest. One
        that has the same letter before it as the test suffix is the tail of a longer match and left out, so that no
        two matches of a page and an item lie within each other on one diagonal.
        """
        code, key = self.coded(items)
        at = items.suffixes + items.item  # behind each item stands one more letter
        low, high = self.interval(key, at, items.seeds[items.item])
        some = np.flatnonzero(high > low)
        low, high, at, item, place = low[some], high[some], at[some], items.item[some], items.place[some]
        found, begin, many = [], 0, np.cumsum(high - low)
        while begin < len(low):
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + AT_ONCE, "right")))
            for a in range(int(low[begin]), int(high[begin]), AT_ONCE) if end == begin + 1 else (None,):
                if a is None:
                    where, which = _ranges(low[begin:end], high[begin:end])
                    which += begin
                else:
                    where = np.arange(a, min(a + AT_ONCE, int(high[begin])))
                    which = np.full(len(where), begin)
                p, q = self.array[where], at[which]
                first = (place[which] == 0) | (self.code[p - 1] != code[q - 1])
                p, q, which = p[first], q[first], which[first]
                length = self._extended(p, q, key)
                page = self.page[p]
                found.append((page, item[which], p - self.starts[page], place[which], length))
            begin = end
        if not found:
            return (np.zeros(0, np.int64),) * 5
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _extended(self, p: np.ndarray, q: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Letters in which the suffix at ``p`` and the test suffix at ``q`` agree."""
        length, going = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(going):
            differ = self.key[p[going] + length[going]] ^ key[q[going] + length[going]]
            for j in range(self.per):
                length[going] += differ >> np.uint64(self.bits * (self.per - 1 - j)) == 0
            going = going[differ == 0]
        return length


def _covered(pair: np.ndarray, q: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Letters of the item covered by any match, for each pair 0..n-1."""
    if not len(q):
        return np.zeros(n)
    order = np.lexsort((q, pair))
    pair, begin, end = pair[order], q[order], (q + length)[order]
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + pair * step)
    before = np.r_[-1, reach[:-1]]
    fresh = np.maximum(0, end + pair * step - np.maximum(begin + pair * step, before))
    return np.bincount(pair, fresh, n)


def _bound(pair: np.ndarray, p: np.ndarray, q: np.ndarray, length: np.ndarray, n: int, unit: float) -> np.ndarray:
    """No chain of a pair 0..n-1 can score more than this.

    Each match but a chain's first pays at least a step, a far one unless another match lies near its diagonal; what it
    adds is then covered by the match without that many letters at its start.
    """
    diagonal = p - q
    order = np.lexsort((diagonal, pair))
    near = (np.diff(pair[order]) == 0) & (np.diff(diagonal[order]) <= NEAR * unit)
    step = np.empty(len(pair))
    step[order] = np.where(np.r_[near, False] | np.r_[False, near], NEAR_STEP, FAR_STEP) * unit
    step = np.minimum(np.floor(step).astype(np.int64), length)
    return _covered(pair, q + step, length - step, n) + FAR_STEP * unit


def _ceilings(starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray, length: np.ndarray, unit: float) -> np.ndarray:
    """No chain of a pair can score more than this, but for rounding of whole scores.

    Of what ``_steps`` asks for only the step itself, the item's letters between two matches, their overlap in the item
    and what the page passes over at a far step are counted, so that every step is allowed and none costs more; each is
    a little cheaper than there, by more than single precision rounds. The matches of a pair lie in a column.
    """
    out, far_step = np.empty(len(starts)), np.float32((FAR_STEP - NEAR_STEP) * unit)
    near_step, near, missing, passed = np.float32((NEAR_STEP - 0.01) * unit), np.float32(NEAR * unit + 0.01), np.float32(MISSING), np.float32(PASSED)
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for w in np.unique(width):
        pairs, n, row = np.flatnonzero(width == w), max(1, CELLS // int(w)), np.arange(w)[:, None]
        for a in range(0, len(pairs), n):
            some = pairs[a : a + n]
            at = starts[some] + np.minimum(row, sizes[some] - 1)
            begin, score, place = q[at].astype(np.float32), length[at].astype(np.float32), (p[at] - p[starts[some]]).astype(np.float32)
            end, diagonal = begin + score, place - begin
            passing, far = passed * place + far_step, score + passed * (place + score)
            for j in range(1, int(w)):
                gap = begin[j] - end[:j]
                value = np.where(np.abs(diagonal[:j] - diagonal[j]) <= near, score[:j], far[:j] - passing[j])
                value -= np.maximum(missing * gap, -gap)
                more = np.maximum(value.max(axis=0) - near_step, 0)
                score[j] += more
                far[j] += more
            out[some] = np.where(row < sizes[some], score, 0).max(axis=0)
    return out


def _promising(starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray, length: np.ndarray, unit: float, letters_: np.ndarray) -> np.ndarray:
    """The pairs that may have a chain of CHAIN of the item's letters: whatever is left out has none."""
    least = 0.99 * CHAIN * letters_  # single precision is far nearer than that
    some = np.flatnonzero(np.add.reduceat(length, starts) - (sizes - 1) * NEAR_STEP * unit >= least)
    few = (sizes[some] <= CEILED) & (np.maximum(p[starts[some] + sizes[some] - 1], letters_[some]) < CEILED_LETTERS)
    many, few = some[~few], some[few]
    few = few[_ceilings(starts[few], sizes[few], p, q, length, unit) >= least[few]]
    if len(many):
        at, pair = _ranges(starts[many], starts[many] + sizes[many])
        a, b, n = p[at], q[at], length[at]
        many = many[(_covered(pair, b, n, len(many)) >= least[many]) & (_bound(pair, a, b, n, len(many), unit) >= least[many])]
    return np.sort(np.r_[few, many])


def _order(page: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The order by page, item, place in page and place in item; all in one number where that holds them."""
    many = [int(x.max()) + 1 for x in (page, item, p, q)]
    if many[0] * many[1] * many[2] * many[3] >= 1 << 63:
        return np.lexsort((q, p, item, page))
    return np.argsort(((page.astype(np.int64) * many[1] + item) * many[2] + p) * many[3] + q)


#: Of chains: score, begin and end in the item, letters matched, begin and end in the page.
Chains = tuple[np.ndarray, ...]


def _steps(p: np.ndarray, q: np.ndarray, length: np.ndarray, pj: np.ndarray, qj: np.ndarray, lj: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """What the step from each match to a later one costs, infinite where there is none, and by how much they overlap.

    Near the match's diagonal letters are misread, replaced or missing, or words are. Else the page alone has gone on,
    over an advert or the line of another column; that costs more, so scattered likeness adds up to nothing.
    """
    gap_q, gap_p = qj - q - length, pj - p - length
    gq, gp = np.maximum(gap_q, 0), np.maximum(gap_p, 0)
    near = np.abs(gap_p - gap_q) <= NEAR * unit
    over = np.maximum(0, -np.minimum(gap_q, gap_p))
    ok = (qj > q) & (gap_q <= HOLE * unit) & np.where(near, over < np.minimum(length, lj) - 2 * unit, (gap_p >= 0) & (over < np.minimum(OVERLAP * unit, lj - 2 * unit)))
    cost = np.where(near, NEAR_STEP * unit + MISSING * np.maximum(gq, gp), FAR_STEP * unit + MISSING * gq + PASSED * gp) + over
    return np.where(ok, cost, np.inf), over


def _chains(starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray, length: np.ndarray, unit: float, letters_: np.ndarray) -> Chains:
    """For each pair the best run of matches in order.

    The matches of a pair lie from ``starts`` on, by page and item place; ``letters_`` is the size of its item.
    """
    n = len(starts)
    out = np.zeros(n), *[np.zeros(n, np.int64) for _ in range(5)]
    width = np.where(sizes <= WIDTH, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    for w in np.unique(width[width > 0]):
        pairs = np.flatnonzero(width == w)
        for a in range(0, len(pairs), max(1, (1 << 18) // int(w))):
            some = pairs[a : a + max(1, (1 << 18) // int(w))]
            at = starts[some][:, None] + np.minimum(np.arange(w), sizes[some][:, None] - 1)
            real = np.arange(w) < sizes[some][:, None]
            for o, x in zip(out, _chained(p[at], q[at], length[at], real, unit), strict=True):
                o[some] = x
    for k in np.flatnonzero(width == 0):
        s = slice(int(starts[k]), int(starts[k] + sizes[k]))
        for o, x in zip(out, _long_chain(p[s], q[s], length[s], unit, int(letters_[k])), strict=True):
            o[k] = x
    return out


def _chained(p: np.ndarray, q: np.ndarray, length: np.ndarray, real: np.ndarray, unit: float) -> Chains:
    """Pairs of up to as many matches as there are columns, a row each."""
    score, begin, matched, origin = length.astype(np.float64), q.copy(), length.copy(), p.copy()
    row = np.arange(len(p))
    for j in range(1, p.shape[1]):
        cost, over = _steps(p[:, :j], q[:, :j], length[:, :j], p[:, j : j + 1], q[:, j : j + 1], length[:, j : j + 1], unit)
        value = score[:, :j] - cost
        k = np.argmax(value, axis=1)
        top = value[row, k]
        better = np.flatnonzero(top > 0)
        k = k[better]
        score[better, j] += top[better]
        begin[better, j], origin[better, j], matched[better, j] = begin[better, k], origin[better, k], matched[better, k] + length[better, j] - over[better, k]
    j = np.argmax(np.where(real, score, -1.0), axis=1)
    return score[row, j], begin[row, j], (q + length)[row, j], matched[row, j], origin[row, j], (p + length)[row, j]


def _long_chain(p: np.ndarray, q: np.ndarray, length: np.ndarray, unit: float, letters_: int) -> tuple[float, ...]:
    """The same for one pair of very many matches.

    Near steps come from matches close by in the page. Of the others only the best for each place in the item at which
    it ends can matter, whatever their number: what the page passes over costs the same for each letter.
    """
    whole = np.flatnonzero(length == letters_)
    if len(whole):
        return float(letters_), 0, letters_, letters_, int(p[whole[0]]), int(p[whole[0]]) + letters_  # no chain has more
    n, end, stop = len(p), q + length, p + length
    score, begin, matched, origin = length.astype(np.float64), q.copy(), length.copy(), p.copy()
    best, holder = np.full(letters_ + 1, -np.inf), np.zeros(letters_ + 1, np.int64)
    close = np.searchsorted(p, p - (HOLE + NEAR) * unit - length.max())
    by_stop, waiting = np.argsort(stop, kind="stable"), 0
    for j in range(1, n):
        while waiting < n and stop[by_stop[waiting]] <= p[j]:
            i = by_stop[waiting]
            if score[i] + PASSED * stop[i] > best[end[i]]:
                best[end[i]], holder[end[i]] = score[i] + PASSED * stop[i], i
            waiting += 1
        near = slice(int(close[j]), j)
        cost, _ = _steps(p[near], q[near], length[near], p[j], q[j], length[j], unit)
        top, i = 0.0, -1
        if len(cost):
            value = score[near] - cost
            k = int(np.argmax(value))
            top, i = float(value[k]), near.start + k
        low, high = max(0, int(np.ceil(q[j] - HOLE * unit))), int(min(letters_, q[j] + np.ceil(min(OVERLAP * unit, length[j] - 2 * unit)) - 1))
        if low <= high:
            gap = q[j] - np.arange(low, high + 1)
            value = best[low : high + 1] - PASSED * p[j] - FAR_STEP * unit - np.where(gap > 0, MISSING * gap, -gap)
            k = int(np.argmax(value))
            if value[k] > top and q[holder[low + k]] < q[j]:
                top, i = float(value[k]), int(holder[low + k])
        if top > 0 and i >= 0:
            over = max(0, int(end[i] - q[j]), int(stop[i] - p[j]))
            score[j] += top
            begin[j], origin[j], matched[j] = begin[i], origin[i], matched[i] + length[j] - over
    j = int(np.argmax(score))
    return float(score[j]), int(begin[j]), int(end[j]), int(matched[j]), int(origin[j]), int(stop[j])


RESULT = "doc_id bigint, item_id bigint, from_letter int, to_letter int, share double, longest int"
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("from_letter", pa.int32()), ("to_letter", pa.int32()), ("share", pa.float64()), ("longest", pa.int32())])


def _onward(page: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """How far a stretch goes on letter by letter, misread ones included: letters, and those of them that agree."""
    n = min(len(page), len(item))
    if not n:
        return 0, 0
    same = page[:n] == item[:n]
    gain = np.cumsum(np.where(same, 1, -1))
    k = int(np.argmax(gain))
    return (k + 1, int(same[: k + 1].sum())) if gain[k] > 0 else (0, 0)


def _held(items: Items, found: tuple[np.ndarray, ...], flat: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
    """(page, item, first and last letter of the item's stretch, its share, longest verbatim match) from all matches of some pages.

    ``flat`` and ``at``: the pages' letters. The ends of a chain are misread as well as its middle, so it goes on at both.
    """
    page, item, p, q, length = found
    out = []
    for wide in (False, True):
        own = np.flatnonzero(items.is_wide[item] == wide)
        if not len(own):
            continue
        own = own[_order(page[own], item[own], p[own], q[own])]
        pg, it, a, b, n = page[own], item[own], p[own], q[own], length[own]
        new = np.r_[True, (pg[1:] != pg[:-1]) | (it[1:] != it[:-1])]
        starts = np.flatnonzero(new)
        sizes, unit = np.diff(np.r_[starts, len(own)]), 0.4 if wide else 1.0
        size = items.sizes[it[starts]]
        longest = np.maximum.reduceat(n, starts)
        some = _promising(starts, sizes, a, b, n, unit, size)
        chains = _chains(starts[some], sizes[some], a, b, n, unit, size[some])
        for k in np.flatnonzero(chains[0] >= CHAIN * size[some]):
            first = starts[some[k]]
            doc, which = int(pg[first]), int(it[first])
            score, begin, end, matched, origin, stop = (x[k] for x in chains)
            text, letters_ = flat[at[doc] : at[doc + 1]], items.flat[items.at[which] : items.at[which + 1]]
            before, same = _onward(text[:origin][::-1], letters_[:begin][::-1])
            behind, also = _onward(text[stop:], letters_[end:])
            begin, end, matched, score = begin - before, end + behind, matched + same + also, score + 2 * (same + also) - before - behind
            stretch, whole = int(end - begin), len(letters_)
            if stretch >= (SHARE - SLACK) * whole and matched >= 0.5 * stretch and score >= SCORE * whole:
                out.append((doc, which, int(begin), int(end), stretch / whole, int(longest[some[k]])))
    return out


def _arrays(flat: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, SuffixArray]]:
    """The suffix arrays of a shard, each with the numbers of its pages: pages with wide letters, of which there are very many, have their own."""
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    wide = np.bincount(own, _wide(flat), len(n)) > 0
    out = []
    for kind in (False, True):
        pages = np.flatnonzero((wide == kind) & (n > 0))
        if len(pages):
            out.append((pages, SuffixArray(flat[wide[own] == kind], np.r_[0, np.cumsum(n[pages])])))
    return out


def search(blocks: list[Items], ids: list[int], texts: list[str]) -> list[tuple]:
    """Rows of RESULT for a shard of whole pages."""
    flat, at = letters(texts)
    arrays, out = _arrays(flat, at), []
    for items in blocks:
        for pages, array in arrays:
            page, *rest = array.matches(items)
            out += [(ids[r[0]], int(items.ids[r[1]]), *r[2:]) for r in _held(items, (pages[page], *rest), flat, at)]
    return out


def search_long(blocks: list[Items], doc: int, text: str) -> list[tuple]:
    """The same for one page that is longer than a shard: its parts are searched one by one, their matches chained together."""
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in blocks]
    whole, before = [], 0
    for start in range(0, max(1, len(text) - JOINT), SHARD_CHARS):
        flat, at = letters([text[start : start + SHARD_CHARS], text[start + SHARD_CHARS : start + SHARD_CHARS + JOINT]])
        for _, array in _arrays(flat, at[[0, 2]]):
            for items, parts in zip(blocks, found, strict=True):
                page, item, p, q, length = array.matches(items)
                parts.append((page, item, p + before, q, length))
        before += int(at[1])
        whole.append(flat[: at[1]] if start + SHARD_CHARS + JOINT < len(text) else flat)
    flat, out = np.concatenate(whole), []
    for items, parts in zip(blocks, found, strict=True):
        if parts:
            matches = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            out += [(doc, int(items.ids[r[1]]), *r[2:]) for r in _held(items, matches, flat, np.array([0, len(flat)]))]
    return out


def _searcher(shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [s.value for s in shared]
        ids: list[int] = []
        texts: list[str] = []
        held = 0

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)

        for batch in batches:
            texts_in = batch["text"].to_pylist()
            boxes = _edges(batch) if "x0" in batch.schema.names else [None] * len(texts_in)
            for doc, text, edges in zip(batch["doc_id"].to_pylist(), texts_in, boxes, strict=True):
                ordered = column_order(text, edges) if edges else None
                for version in (text, ordered):
                    if version is None:
                        continue
                    if len(version) > SHARD_CHARS + JOINT:
                        yield result(search_long(blocks, doc, version))
                        continue
                    ids.append(doc)
                    texts.append(version)
                    held += len(version)
                    if held >= SHARD_CHARS:
                        yield result(search(blocks, ids, texts))
                        ids, texts, held = [], [], 0
        if ids:
            yield result(search(blocks, ids, texts))

    return run


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The test items in blocks of at most BLOCK_LETTERS characters (a longer item is a block of its own)."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        if ids and size + len(r[1]) > BLOCK_LETTERS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    yield Items(ids, texts)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pages that hold a running stretch of at least a third of an item's letters.

    One row for each (doc_id, item_id): the stretch as ``from_letter`` and ``to_letter`` of the item's letters, its
    ``share`` of them and the ``longest`` verbatim match. Only letters count; case, accents and look-alike letters are
    set aside. Null and empty texts hold nothing, a null doc_id is reported as such.
    Each shard of pages gets its suffix array where it is read, and every test suffix is searched for in it, while the
    array is in memory; nothing of a page is stored, and none is moved unless a few
    tasks would read them all. The pages are read once for BLOCKS blocks of test items,
    each of bounded size, which is what the executors hold of them.
    A page whose columns alternate is searched in the order of its columns as well, by the boxes of its ``lines`` (if
    there are any), and the better stretch counts.
    """
    pages = documents.where(F.col("text").isNotNull()).select("doc_id", "text", *(edge_columns() if "lines" in documents.columns else []))
    pages, context, blocks = spread(pages), documents.sparkSession.sparkContext, _blocks(items)
    got = None
    while shared := [context.broadcast(b) for b in islice(blocks, BLOCKS)]:
        part = pages.mapInArrow(_searcher(shared), RESULT)
        got = part if got is None else got.unionAll(part)
    best = F.max_by(F.struct("from_letter", "to_letter", "share", "longest"), F.struct("share", "longest")).alias("b")
    return got.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without the pages that hold any item; rows with a null doc_id stay."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
