"""Edit distances of many pairs of texts at once, by bit vectors."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Characters of a pattern up to which pairs are taken in step; longer ones by themselves, with one long number.
IN_STEP = 4096
#: Bytes of a batch's table of matches, pairs of a batch, and columns after which pairs that are decided leave it.
TABLE_BYTES, BATCH, COLUMNS = 16_000_000, 2048, 64
#: Characters from which on a pair is first tried word by word, and words that are skipped at most to go on.
WORDY, RESUME = 400, 8
#: Pairs of a batch below which a step costs more than the pairs by themselves.
FEW = 32
_ONE = np.uint64(1)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """The two texts without the longest beginning, and then the longest end, that they share."""
    for _ in range(2):
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid - 1
        a, b = a[:low:-1] + a[low : low + 1], b[:low:-1] + b[low : low + 1]
    return a, b


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Levenshtein distance; a column of the matrix is one number, a bit per character of ``a``.

    With a limit, what is surely over it is given as some number over it.
    """
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for j, c in enumerate(b):
        match = where.get(c, 0)
        zero = (((match & up) + up) ^ up) | match | down
        rise, fall = down | full & ~(zero | up), zero & up
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | full & ~(zero | rise), rise & zero
        if limit is not None and distance - (len(b) - 1 - j) > limit:
            return limit + 1
    return distance


def at_most(a: str, b: str, limit: int) -> int:
    """A number of edits that surely make one text of the other, word by word, going on where two words are equal again; or one over the limit."""
    u, v = a.split(" "), b.split(" ")
    i = j = edits = 0
    while i < len(u) and j < len(v):
        if edits > limit:
            return edits
        if u[i] == v[j]:
            i, j = i + 1, j + 1
            continue
        found = next(((s, d - s) for d in range(1, RESUME) for s in range(d + 1) if u[i + s : i + s + 2] == v[j + d - s : j + d - s + 2] != []), None)
        s, t = found or (1, 1)
        edits += max(sum(map(len, u[i : i + s])) + s, sum(map(len, v[j : j + t])) + t)
        i, j = i + s, j + t
    return edits + sum(map(len, u[i:])) + len(u) - i + sum(map(len, v[j:])) + len(v) - j


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


def _in_step(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """Whether each pair is within its limit; every ``a`` has a character, is no longer than its ``b``, and has IN_STEP at most.

    Rows of a column are cut into words of 64 bits. Word w is one column behind word w - 1, so that what
    that one carried over is known, and all words of all pairs take a step at once. Only words near the
    diagonal do: a way through others has more edits than the limit. What lies beyond them is taken for
    rising by one from cell to cell, which is never too small.
    """
    (x, m), (y, n) = _codes(a), _codes(b)
    size = int(max(x.max(), y.max())) + 1
    used = np.zeros(size, np.int64)
    used[x] = 1
    number = np.cumsum(used) * used  # 0 for what no pattern has
    kinds, words, pairs = int(used.sum()) + 1, int(-(-m.max() // 64)), len(a)
    table = np.zeros((pairs, words, kinds), np.uint64)
    row, at = np.repeat(np.arange(pairs), m), np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
    np.add.at(table.reshape(-1), (row * words + (at >> 6)) * kinds + number[x], _ONE << (at & 63).astype(np.uint64))
    flat_table, spread = table.reshape(-1), (np.arange(pairs)[:, None] * words + np.arange(words)[None, :]) * kinds
    text = np.zeros((pairs, int(n.max()) + 2 * words), np.int32)
    text[np.repeat(np.arange(pairs), n), words + np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)] = number[y]
    last, bit = (m - 1) >> 6, ((m - 1) & 63).astype(np.uint64)
    up, down = np.full((pairs, words), ~np.uint64(0)), np.zeros((pairs, words), np.uint64)
    rises, falls = np.ones((pairs, words + 1), np.uint64), np.zeros((pairs, words + 1), np.uint64)
    score, good, own = m.copy(), np.zeros(pairs, bool), np.arange(pairs)
    # Distances at the end of the lowest word that has begun, now and a step ago.
    edge = earlier = np.full(pairs, 64)
    top, widest, begun = np.uint64(63), int(limits.max()), 1
    for step in range(int((n + last).max())):
        # Word w is at column step - w, and its rows are 64 w to 64 w + 63.
        low = max(0, -(-(step - widest - 63) // 65))
        high = min(words, (step + widest) // 65 + 1, step + 1)
        if low >= words:
            break
        w = slice(low, high)
        match = flat_table[spread[:, w] + text[:, words + step - high + 1 : words + step - low + 1][:, ::-1]]
        # What the word above carried a step ago; the row above the first word rises in each column.
        plus, minus = rises[:, w], falls[:, w]
        if low:
            plus, minus = plus.copy(), minus.copy()
            plus[:, 0], minus[:, 0] = 1, 0
        own_up, own_down = up[:, w], down[:, w]
        both = match | own_down
        match |= minus
        zero = match & own_up
        zero += own_up
        zero ^= own_up
        zero |= match
        rise, fall = own_down | ~(zero | own_up), own_up & zero
        if high > begun:  # a word begins, from where the word above was a step before its last
            begun = high
            new = last == high - 1
            score[new] = earlier[new] + m[new] - 64 * (high - 1)
            edge = earlier + 64
        earlier = edge
        edge = edge + (rise[:, -1] >> top).astype(np.int64) - (fall[:, -1] >> top).astype(np.int64)
        column = step - last
        counts = (column >= 0) & (column < n) & (last >= low) & (last < high)
        if counts.any():
            c = np.flatnonzero(counts)
            k = last[c] - low
            score[c] += ((rise[c, k] >> bit[c]) & _ONE).astype(np.int64) - ((fall[c, k] >> bit[c]) & _ONE).astype(np.int64)
        new_rises, new_falls = rise >> top, fall >> top
        rise <<= _ONE
        rise |= plus
        fall <<= _ONE
        fall |= minus
        up[:, w] = fall | ~(both | rise)
        down[:, w] = rise & both
        rises[:, low + 1 : high + 1], falls[:, low + 1 : high + 1] = new_rises, new_falls
        if step % COLUMNS == COLUMNS - 1:
            left = n - 1 - column
            done = (left <= 0) | (score - left > limits) & (last < begun)
            if 4 * np.count_nonzero(done) >= len(own):
                good[own[done & (left <= 0) & (score <= limits)]] = True
                go = np.flatnonzero(~done)
                if not len(go):
                    return good
                own, m, n, last, bit, score, limits, edge, earlier = (v[go] for v in (own, m, n, last, bit, score, limits, edge, earlier))
                spread, text, up, down, rises, falls = (v[go] for v in (spread, text, up, down, rises, falls))
    good[own[score <= limits]] = True
    return good


def within(a: list[str], b: list[str], limits: np.ndarray, likely: bool = True) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit. Pairs that likely are tried word by word first."""
    out = np.zeros(len(a), bool)
    left: list[tuple[int, int, str, str]] = []
    for k, (x, y, limit) in enumerate(zip(a, b, limits.tolist(), strict=True)):
        if abs(len(x) - len(y)) > limit:
            continue
        x, y = trimmed(x, y)
        if len(x) > len(y):
            x, y = y, x
        if len(y) <= limit or likely and len(x) >= WORDY and at_most(x, y, limit) <= limit:
            out[k] = True
        elif len(x) > IN_STEP:
            out[k] = edit_distance(x, y, limit) <= limit
        elif x:
            left.append((len(x), k, x, y))
    left.sort()
    at = 0
    while at < len(left):
        # Pairs of like lengths; a table has a word per character that occurs, at most some hundreds as a rule.
        words = left[at][0] // 64 + 1
        to = at + bisect_left(left[at : at + BATCH], (64 * (words + words // 4 + 1),))
        while to - at > 1:
            kinds = len(set().union(*(x for _, _, x, _ in left[at:to]))) + 1
            wide = max(len(y) for _, _, _, y in left[at:to])
            if (to - at) * (kinds * (left[to - 1][0] // 64 + 1) + wide) * 8 <= TABLE_BYTES:
                break
            to = at + (to - at) // 2
        some = left[at:to]
        own = np.array([k for _, k, _, _ in some])
        if len(some) < FEW:
            out[own] = [edit_distance(x, y, int(limits[k])) <= limits[k] for _, k, x, y in some]
            at = to
            continue
        out[own] = _in_step([x for _, _, x, _ in some], [y for _, _, _, y in some], limits[own])
        at = to
    return out
