"""Token bucket and circuit breaker as maps of blocks (see ``plans/blockscan.py``).

Both count in whole microseconds (the bucket in a fraction of them that fits its rate), so that it makes no difference
where a block begins.  Times do not go back along seq; where they do, no time has passed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from recollect.operators.machines import CLOSED, HALF_OPEN, OPEN
from recollect.plans.blockscan import Numbers, Rule

#: (from, to, slope, offset): a state x in [from, to) becomes slope * x + offset.
Pieces = list[tuple[int, int, int, int]]


def _joined(pieces: Pieces) -> Pieces:
    """Without empty pieces and those that only go on as the one before."""
    out: Pieces = []
    for lo, hi, slope, off in pieces:
        if lo >= hi:
            continue
        if out and out[-1][2:] == (slope, off):
            out[-1] = (out[-1][0], hi, slope, off)
        else:
            out.append((lo, hi, slope, off))
    return out


def refilled(pieces: Pieces, gain: int, cap: int) -> Pieces:
    out: Pieces = []
    for lo, hi, slope, off in pieces:
        full = min(hi, max(lo, cap - off - gain)) if slope else lo  # from here on the bucket overflows
        out.append((lo, full, 1, off + gain))
        out.append((full, hi, 0, cap if slope else min(cap, off + gain)))
    return _joined(out)


def spent(pieces: Pieces, cost: int) -> Pieces:
    out: Pieces = []
    for lo, hi, slope, off in pieces:
        if slope:
            pays = min(hi, max(lo, cost - off))  # from here on there is a token
            out += [(lo, pays, 1, off), (pays, hi, 1, off - cost)]
        else:
            out.append((lo, hi, 0, off - cost if off >= cost else off))
    return _joined(out)


def through(pieces: Pieces, then: Pieces) -> Pieces:
    """First ``pieces``, then ``then``."""
    out: Pieces = []
    for lo, hi, slope, off in pieces:
        if not slope:
            _, _, s, o = next(p for p in then if p[0] <= off < p[1])
            out.append((lo, hi, 0, s * off + o))
            continue
        for a, b, s, o in then:
            out.append((max(lo, a - off), min(hi, b - off), s, s * off + o))
    return _joined(out)


def token_bucket(rate: float, burst: int) -> Rule:
    """allowed, tokens left and seconds to wait.  State: tokens (scaled), time of the last arrival.

    A map says what becomes of the tokens found at the first arrival of a block (after refilling), in at most
    2 * (burst + 1) pieces: more tokens never allow fewer arrivals, and at most ``burst`` more of them.
    """
    scale = 1_000_000
    while scale > 1 and burst / rate * 1e6 * scale > 2**60:
        scale //= 10
    cost = max(1, round(1e6 / rate * scale))
    cap = burst * cost

    def mapped(rows: pd.DataFrame) -> Numbers:
        times = rows["at"].tolist()
        pieces: Pieces = [(0, cap + 1, 1, 0)]
        last = times[0]
        for at in times:
            if at > last:
                pieces = refilled(pieces, min(cap, (at - last) * scale), cap)
                last = at
            pieces = spent(pieces, cost)
        return [times[0], last, *(x for p in pieces for x in p)]

    def parts(m: Numbers) -> Pieces:
        return [tuple(m[i : i + 4]) for i in range(2, len(m), 4)]

    def composed(a: Numbers, b: Numbers) -> Numbers:
        gain = min(cap, max(0, b[0] - a[1]) * scale)
        pieces = through(refilled(parts(a), gain, cap), parts(b))
        return [a[0], max(a[1], b[1]), *(x for p in pieces for x in p)]

    def applied(m: Numbers, state: Numbers) -> Numbers:
        tokens = min(cap, state[0] + max(0, m[0] - state[1]) * scale) if len(state) > 1 else cap
        _, _, slope, off = next(p for p in parts(m) if p[0] <= tokens < p[1])
        return [slope * tokens + off, max(m[1], state[1] if len(state) > 1 else m[1])]

    def run(state: Numbers, rows: pd.DataFrame, entered: list) -> tuple[Numbers, dict[str, list]]:
        tokens, last = state if len(state) > 1 else (cap, None)
        allowed, left, wait = [], [], []
        for at, begins in zip(rows["at"].tolist(), entered, strict=True):
            if begins is not None:
                tokens, last = begins if len(begins) > 1 else (cap, None)
            if last is not None and at > last:
                tokens = min(cap, tokens + (at - last) * scale)
            last = at if last is None else max(at, last)
            ok = tokens >= cost
            tokens -= cost if ok else 0
            allowed.append(ok)
            left.append(tokens / cost)
            wait.append(max(0, cost - tokens) / scale / 1e6)
        return (state if last is None else [tokens, last]), {"allowed": allowed, "tokens": left, "retry_after_s": wait}

    return Rule([cap], mapped, composed, applied, run)


def breaker(failures: int, reset_s: float) -> Rule:
    """State seen by each call, whether it was rejected, state after.  State: failures so far, time of the last one.

    ``failures`` stands for open.  A map has one exit for each count a closed breaker is entered with.  An open one
    only waits for the first call after its time, so its exits are a step function of the time of its last failure:
    (up to which time, exit), the last step for a breaker that stays open throughout.
    """
    reset = round(reset_s * 1e6)

    def mapped(rows: pd.DataFrame) -> Numbers:
        at = np.maximum.accumulate(rows["at"].to_numpy(dtype=np.int64))
        ok, times, n = rows["ok"].tolist(), at.tolist(), len(rows)
        again = np.searchsorted(at, at + reset).tolist()  # the first call after a failure here has run out
        closed = [(c, 0) for c in range(failures)]  # exits for counts of failures, seen from the end
        half = [(0, 0)] * n
        for i in range(n - 1, -1, -1):
            if ok[i]:
                closed, half[i] = [closed[0]] * failures, closed[0]
            else:
                j = max(again[i], i + 1)
                half[i] = (failures, times[i]) if j >= n else half[j]
                closed = [*(closed[c + 1] for c in range(failures - 1)), half[i]]
        return _packed(closed, _steps([(t - reset, e) for t, e in zip(times, half, strict=True)]))

    def composed(a: Numbers, b: Numbers) -> Numbers:
        (closed, steps), later = _unpacked(a, failures), _unpacked(b, failures)
        end = steps[-1][0] if steps else None
        both = [(t, _exit(later, e, failures)) for t, e in steps]
        both += [(t, e) for t, e in later[1] if end is None or t > end]
        return _packed([_exit(later, e, failures) for e in closed], _steps(both))

    def applied(m: Numbers, state: Numbers) -> Numbers:
        return list(_exit(_unpacked(m, failures), tuple(state), failures))

    def run(state: Numbers, rows: pd.DataFrame, entered: list) -> tuple[Numbers, dict[str, list]]:
        count, failed_at = state
        phase, now = OPEN if count >= failures else CLOSED, None
        seen, rejected, after = [], [], []
        for at, ok, begins in zip(rows["at"].tolist(), rows["ok"].tolist(), entered, strict=True):
            if begins is not None:
                count, failed_at = begins
                phase, now = OPEN if count >= failures else CLOSED, None
            now = at if now is None else max(now, at)
            if phase == OPEN and now - failed_at >= reset:
                phase = HALF_OPEN
            seen.append(phase)
            rejected.append(phase == OPEN)
            if phase != OPEN:
                if ok:
                    phase, count = CLOSED, 0
                else:
                    phase, count, failed_at = (OPEN if phase == HALF_OPEN or count + 1 >= failures else CLOSED), count + 1, now
            after.append(phase)
        end = [failures, failed_at] if phase == OPEN else [count, 0]
        return end, {"state": seen, "rejected": rejected, "state_after": after}

    return Rule([0, 0], mapped, composed, applied, run)


Exit = tuple[int, int]
Step = tuple[int, Exit]


def _steps(steps: list[Step]) -> list[Step]:
    """Steps by time; of neighbours with one exit only the later."""
    out: list[Step] = []
    for time, to in steps:
        if out and (out[-1][1] == to or out[-1][0] == time):
            if out[-1][1] == to:
                out[-1] = (time, to)
        else:
            out.append((time, to))
    return out


def _exit(m: tuple[list[Exit], list[Step]], state: Exit, failures: int) -> Exit:
    closed, steps = m
    if state[0] < failures:
        return closed[state[0]]
    lo, hi = 0, len(steps)
    while lo < hi:  # the first step that is not before the time
        mid = (lo + hi) // 2
        if steps[mid][0] < state[1]:
            lo = mid + 1
        else:
            hi = mid
    return steps[lo][1] if lo < len(steps) else state


def _packed(closed: list[Exit], steps: list[Step]) -> Numbers:
    return [*(x for e in closed for x in e), *(x for t, e in steps for x in (t, *e))]


def _unpacked(m: Numbers, failures: int) -> tuple[list[Exit], list[Step]]:
    closed = [(m[2 * i], m[2 * i + 1]) for i in range(failures)]
    return closed, [(m[i], (m[i + 1], m[i + 2])) for i in range(2 * failures, len(m), 3)]
