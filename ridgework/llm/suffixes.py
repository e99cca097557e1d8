"""Front-coded sorted runs of suffixes and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known equal and are not looked at."""
    low, high, step = known, min(len(a), len(b)), 16
    while low + step < high:
        if a[low:low + step] != b[low:low + step]:
            high = low + step
            break
        low, step = low + step, 2 * step
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def front_code(ordered: Sequence[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Of sorted strings the prefix length shared with the one before, and what follows it."""
    shared, rests, last = np.zeros(len(ordered), np.int32), [], b""
    for i, text in enumerate(ordered):
        shared[i] = common_prefix(last, text)
        rests.append(text[shared[i]:])
        last = text
    return shared, rests


def front_decode(shared: Sequence[int], rests: Sequence[bytes]) -> list[bytes]:
    out, last = [], b""
    for prefix, rest in zip(shared, rests):
        last = last[:prefix] + rest
        out.append(last)
    return out


def merge(runs: Sequence[tuple[Sequence[bytes], Sequence[int]]]) -> Iterator[tuple[int, int, int]]:
    """Sorted merge of sorted runs ``(strings, shared prefixes)`` as ``(run, place, prefix shared with the one before)``.

    Every run's head carries the prefix it shares with the last string put out. Of two heads the one
    that shares more comes first; only where both share the same do bytes decide, from there on. The
    loser then knows what it shares with the winner, which is its prefix once the winner is out.
    """
    k = len(runs)
    if not k:
        return
    place, prefix = [0] * k, [0] * k
    heads: list[bytes | None] = [strings[0] if len(strings) else None for strings, _ in runs]

    def beats(x: int, y: int) -> bool:
        """Whether head x comes before head y; leaves in the loser what it shares with the winner."""
        if heads[y] is None:
            return True
        if heads[x] is None:
            return False
        if prefix[x] != prefix[y]:
            return prefix[x] > prefix[y]
        a, b = heads[x], heads[y]
        at = common_prefix(a, b, prefix[x])
        first = at == len(a) and (at < len(b) or x < y) or at < len(a) and at < len(b) and a[at] < b[at]
        prefix[y if first else x] = at
        return first

    losers = [-1] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        yield winner, place[winner], prefix[winner]
        strings, shared = runs[winner]
        place[winner] += 1
        at = place[winner]
        heads[winner], prefix[winner] = (strings[at], int(shared[at])) if at < len(strings) else (None, 0)
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2
