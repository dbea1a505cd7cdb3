"""Sequential rules as small state machines, used alike by batch and streaming operators."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import astuple, dataclass
from heapq import heappop, heappush

#: Fixed values. Below each loss level, the share of the best loss that counts as an improvement; above them the last.
THRESHOLDS = ((0.015, 0.999), (0.020, 0.998), (0.030, 0.997), (0.050, 0.995))
THRESHOLD_ABOVE = 0.997
ALPHA = 0.1


@dataclass
class Plateau:
    """Counts steps without progress of a loss and, where given, a quality."""

    best_loss: float = math.nan
    best_quality: float = 0.0
    ema_loss: float = math.nan
    ema_quality: float = math.nan
    counter: float = 0.0

    def see(self, loss: float, quality: float | None) -> None:
        has = quality is not None and not math.isnan(quality)
        if math.isnan(self.ema_loss):
            self.ema_loss = self.best_loss = loss
            if has:
                self.ema_quality = self.best_quality = quality
            return
        self.ema_loss = ALPHA * loss + (1 - ALPHA) * self.ema_loss
        if has:
            self.ema_quality = quality if math.isnan(self.ema_quality) else ALPHA * quality + (1 - ALPHA) * self.ema_quality
        share = next((s for level, s in THRESHOLDS if loss < level), THRESHOLD_ABOVE)
        trends = self.ema_loss < self.best_loss * (share + 0.001) and has and self.ema_quality > self.best_quality * 0.9995
        if loss < self.best_loss * share or has and quality > self.best_quality * 1.001 or trends:
            self.best_loss = min(self.best_loss, loss)
            self.best_quality = max(self.best_quality, quality) if has else self.best_quality
            self.counter = 0.0
        elif self.counter > 0 and (loss < self.best_loss * 1.002 or has and quality > self.best_quality * 0.999):
            self.counter = max(0.0, self.counter - 0.5)
        else:
            self.counter += 1

    def state(self) -> tuple:
        return astuple(self)


@dataclass
class RateControl:
    """Plateau and divergence events of a loss, and the learning rate they recommend."""

    rate: float
    patience: int = 300
    factor: float = 1.3
    least: float = 1e-6
    most: float = 1e-3
    rest: int = 100
    best: float = math.inf
    counter: int = 0
    resting: int = 0
    seen: int = 0

    def see(self, loss: float) -> tuple[str, float, float] | None:
        """The event of this step: kind, old and new rate."""
        self.seen = min(1000, self.seen + 1)
        if self.resting > 0:
            self.resting -= 1
            return None
        if loss < self.best * 0.997:
            self.best, self.counter = loss, 0
            return None
        self.counter += 1
        event = None
        if self.counter >= self.patience:
            new = min(self.rate * self.factor, self.most)
            if new > self.rate:
                event = ("plateau", self.rate, new)
                self.rate, self.counter, self.resting = new, 0, self.rest
        if loss > self.best * 1.15 and self.seen > 50:
            new = max(self.rate * 0.6, self.least)
            if new < self.rate:
                event = ("divergence", self.rate, new)
                self.rate, self.best, self.counter, self.resting = new, loss, 0, self.rest
        return event


class SlidingQuantile:
    """The ``q``-quantile, linear between neighbours, of the values among the last ``n`` rows, in log n for each row.

    Two heaps split the values at the quantile: ``low`` ends with the lower neighbour, ``high`` begins with the upper one.
    A row that leaves, or changes sides, stays in its heap until it comes to the top. Rows without a value take a place
    among the last ``n`` only; NaN is greater than all.
    """

    def __init__(self, q: float, n: int):
        self.q, self.n, self.next = q, n, 0
        self.rows: deque[int] = deque()
        self.side: dict[int, bool] = {}  # of rows with a value: whether in ``low``
        self.low: list[tuple[float, int]] = []
        self.high: list[tuple[float, int]] = []
        self.size = {True: 0, False: 0}

    def top(self, low: bool) -> tuple[float, int]:
        heap = self.low if low else self.high
        while self.side.get(heap[0][1]) is not low:
            heappop(heap)
        return heap[0]

    def put(self, value: float, row: int, low: bool) -> None:
        heappush(self.low if low else self.high, (-value if low else value, row))
        self.side[row] = low
        self.size[low] += 1

    def move(self, low: bool) -> None:
        """The top of ``low`` (or of ``high``) to the other side."""
        key, row = self.top(low)
        heappop(self.low if low else self.high)
        self.size[low] -= 1
        self.put(-key if low else key, row, not low)

    def add(self, value: float | None) -> None:
        if len(self.rows) == self.n:
            gone = self.side.pop(self.rows.popleft(), None)
            if gone is not None:
                self.size[gone] -= 1
        self.rows.append(self.next)
        if value is not None:
            value = math.inf if math.isnan(value) else value
            self.put(value, self.next, bool(self.size[True]) and value <= -self.top(True)[0])
        self.next += 1
        known = self.size[True] + self.size[False]
        goal = math.floor((known - 1) * self.q) + 1 if known else 0
        while self.size[True] > goal:
            self.move(True)
        while self.size[True] < goal:
            self.move(False)

    def value(self) -> float | None:
        known = self.size[True] + self.size[False]
        if not known:
            return None
        at = (known - 1) * self.q
        lower = -self.top(True)[0]
        if at == math.floor(at):
            return lower
        upper = self.top(False)[0]
        return lower if lower == upper else (math.floor(at) + 1 - at) * lower + (at - math.floor(at)) * upper
