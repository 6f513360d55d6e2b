"""Small per-key state machines, shared by batch scans and streaming state.

Each machine is a plain function ``(state, rows, fresh) -> (state, columns)`` over ordered rows;
``fresh`` marks where another key begins and the state starts over.  ``state`` is a tuple of
simple values so that a stream can keep it; None is the start.  Times are seconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
# Least rows on each side of a split and in the whole window of the drift test.
SIDE, WHOLE = 10, 20


def token_bucket(rate: float, burst: int):
    """allowed, tokens left and seconds to wait for each arrival; state (tokens, last refill)."""

    def advance(state: tuple | None, rows: pd.DataFrame, fresh: np.ndarray):
        tokens, last = state if state is not None else (float(burst), None)
        allowed, left, wait = [], [], []
        for at, first in zip(rows["at"].tolist(), fresh.tolist()):
            if first:
                tokens, last = float(burst), None
            if last is not None:
                tokens = min(float(burst), tokens + (at - last) * rate)
            last = at
            ok = tokens >= 1.0
            tokens -= 1.0 if ok else 0.0
            allowed.append(ok)
            left.append(tokens)
            wait.append(0.0 if tokens >= 1.0 else (1.0 - tokens) / rate)
        return (tokens, float(last)), {"allowed": allowed, "tokens": left, "retry_after_s": wait}

    return advance


def breaker(failures: int, reset_s: float):
    """State seen by each call, whether it was rejected, state after; state (phase, count, last failure)."""

    def advance(state: tuple | None, rows: pd.DataFrame, fresh: np.ndarray):
        phase, count, failed_at = state if state is not None else (CLOSED, 0, 0.0)
        seen, rejected, after = [], [], []
        for at, ok, first in zip(rows["at"].tolist(), rows["ok"].tolist(), fresh.tolist()):
            if first:
                phase, count, failed_at = CLOSED, 0, 0.0
            if phase == OPEN and at - failed_at >= reset_s:
                phase = HALF_OPEN
            seen.append(phase)
            rejected.append(phase == OPEN)
            if phase != OPEN:
                if ok:
                    phase, count = CLOSED, 0
                else:
                    count, failed_at = count + 1, float(at)
                    if count >= failures:
                        phase = OPEN
            after.append(phase)
        return (phase, int(count), float(failed_at)), {"state": seen, "rejected": rejected, "state_after": after}

    return advance


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def session_context(alpha: float, decay: float):
    """Query vector blended with the running context; state (context, turns).

    The blend uses the context before this turn; the context moves afterwards.  A row that is
    a carried context (``is_context``) only sets the state.
    """

    def advance(state: tuple | None, rows: pd.DataFrame, fresh: np.ndarray):
        context, turns = state if state is not None else (None, 0)
        if context is not None:
            context = np.asarray(context, dtype=np.float64)
        fused, contexts, counts = [], [], []
        flags = rows["is_context"] if "is_context" in rows else np.zeros(len(rows), bool)
        for vec, flag, carried, first in zip(rows["embedding"], flags, rows["turn"], fresh.tolist()):
            if first:
                context, turns = None, 0
            q = np.asarray(vec, dtype=np.float64)
            if flag:
                context, turns, out = q, int(carried), q
            elif context is None:
                context, turns, out = q, 1, q
            else:
                out = _unit(alpha * q + (1 - alpha) * context)
                context, turns = _unit(decay * q + (1 - decay) * context), turns + 1
            fused.append(out.tolist())
            contexts.append(context.tolist())
            counts.append(turns)
        return (None if context is None else context.tolist(), turns), {
            "fused": fused, "context": contexts, "turn": counts,
        }

    return advance


class Window:
    """The newest values of a series with their running sums, in arrays that are moved up rather than made anew.

    A new value adds one sum, a cut or an overflow only moves the start; the change test reads the sums.
    """

    def __init__(self, values: list | np.ndarray, most: int):
        self.most, self.start, self.n = most, 0, 0
        self.values, self.sums = np.zeros(2 * most + 2), np.zeros(2 * most + 3)
        self.values[: len(values)] = values
        self.n = len(values)
        self.sums[1 : self.n + 1] = np.cumsum(self.values[: self.n])

    def add(self, value: float, delta: float) -> int:
        """Take one more value in, drop what a change cuts off, and return where it was cut (0: no change)."""
        if self.n == self.most:
            self.start, self.n = self.start + 1, self.n - 1
        end = self.start + self.n
        if end + 1 >= len(self.sums) - 1:
            self.values[: self.n] = self.values[self.start : end].copy()
            self.sums[1 : self.n + 1] = np.cumsum(self.values[: self.n])
            self.sums[0], self.start, end = 0.0, 0, self.n
        self.values[end] = value
        self.sums[end + 1] = self.sums[end] + value
        self.n += 1
        cut = self.split(delta)
        self.start, self.n = self.start + cut, self.n - cut
        return cut

    def split(self, delta: float) -> int:
        """First split whose sides differ by more than the bound, 0 if there is none."""
        n = self.n
        if n < WHOLE:
            return 0
        sums = self.sums[self.start : self.start + n + 1]
        left = np.arange(SIDE, n - SIDE + 1)
        low = sums[SIDE : n - SIDE + 1] - sums[0]
        right = n - left
        gap = np.abs(low / left - (sums[n] - sums[0] - low) / right)
        bound = np.sqrt(0.5 * (1.0 / left + 1.0 / right) * np.log(4.0 * n / delta))
        hit = np.flatnonzero(gap >= bound)
        return int(left[hit[0]]) if len(hit) else 0

    def kept(self) -> list[float]:
        return self.values[self.start : self.start + self.n].tolist()


def drift(delta: float, max_window: int):
    """Change flag, place of the cut and window length per value; state (window,)."""

    def advance(state: tuple | None, rows: pd.DataFrame, fresh: np.ndarray):
        window = Window([] if state is None else state[0], max_window)
        changed, cuts, sizes = [], [], []
        for value, first in zip(rows["reward"].tolist(), fresh.tolist()):
            if first:
                window = Window([], max_window)
            cut = window.add(float(value), delta)
            changed.append(cut > 0)
            cuts.append(cut)
            sizes.append(window.n)
        return (window.kept(),), {"changed": changed, "cut": cuts, "window_size": sizes}

    return advance


def bandit(arms: int, delta: float, max_window: int):
    """Posterior updates with resets on drift; state (alpha, beta, window, resets).

    A missing arm means the arm that is best at that moment.
    """

    def start() -> tuple:
        return [1.0] * arms, [1.0] * arms, Window([], max_window), 0

    def advance(state: tuple | None, rows: pd.DataFrame, fresh: np.ndarray):
        if state is None:
            alpha, beta, window, resets = start()
        else:
            alpha, beta, window, resets = list(state[0]), list(state[1]), Window(state[2], max_window), int(state[3])
        used, a_out, b_out, reset_out, count_out = [], [], [], [], []
        for arm, reward, first in zip(rows["arm"].tolist(), rows["reward"].tolist(), fresh.tolist()):
            if first:
                alpha, beta, window, resets = start()
            if pd.isna(arm):
                a, b = np.asarray(alpha), np.asarray(beta)
                arm = int(np.argmax(a / (a + b)))
            arm, reset = int(arm), False
            if not pd.isna(reward) and reward != 0.5:
                alpha[arm] += float(reward)
                beta[arm] += 1.0 - float(reward)
                if window.add(float(reward), delta):
                    alpha, beta, resets, reset = [2.0] * arms, [2.0] * arms, resets + 1, True
            used.append(arm)
            a_out.append(alpha[arm])
            b_out.append(beta[arm])
            reset_out.append(reset)
            count_out.append(resets)
        return (alpha, beta, window.kept(), resets), {
            "used_arm": used, "alpha": a_out, "beta": b_out, "reset": reset_out, "resets": count_out,
        }

    return advance
