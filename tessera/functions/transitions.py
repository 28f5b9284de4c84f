"""Step functions of the keyed stateful operators.

Each takes the state and one event and returns the next state and an output;
the batch folds and the streaming processors share them. Times are seconds as
floats unless a name says otherwise.
"""

from __future__ import annotations

import random
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

NS = 1_000_000_000


def every(interval_s: float) -> float:
    """Events per second for one event each ``interval_s``."""
    if interval_s <= 0:
        raise ValueError("the interval must be positive")
    return 1 / interval_s


@dataclass(frozen=True)
class Bucket:
    """A token bucket's state; times in nanoseconds. A new one is full at any time."""

    tokens: float = 0.0
    last: int | None = None


def bucket_tokens(state: Bucket, now: int, limit: float, burst: int) -> tuple[float, int]:
    """Tokens at ``now``, and the time the state counts from (earlier if the clock went back)."""
    if state.last is None:
        return float(burst), now
    last = min(state.last, now)
    longest = int(NS * ((burst - state.tokens) / limit))
    tokens = state.tokens + min(now - last, longest) / NS * limit
    return min(tokens, float(burst)), last


def bucket_allow(state: Bucket, now: int, n: int, limit: float, burst: int) -> tuple[Bucket, bool]:
    tokens, last = bucket_tokens(state, now, limit, burst)
    left = tokens - n
    wait = int(NS * (-left / limit)) if left < 0 else 0
    if n <= burst and wait <= 0:
        return Bucket(left, now), True
    return (state if state.last is None else replace(state, last=last)), False


def bucket_wait(state: Bucket, now: int, n: int, limit: float, burst: int) -> int | None:
    """Nanoseconds until n tokens are there, without taking them; None if that cannot be."""
    tokens, _ = bucket_tokens(state, now, limit, burst)
    wait = int(NS * ((n - tokens) / limit)) if n > tokens else 0
    return None if n > burst or wait > n / limit * NS else wait


@dataclass(frozen=True)
class Counts:
    requests: int = 0
    successes: int = 0
    failures: int = 0
    successes_in_row: int = 0
    failures_in_row: int = 0


CLOSED, HALF_OPEN, OPEN = "closed", "half-open", "open"


@dataclass(frozen=True)
class BreakerRule:
    max_requests: int = 1
    interval: float = 0.0
    timeout: float = 60.0
    should_trip: Callable[[Counts], bool] = lambda c: c.failures_in_row > 5

    def __post_init__(self):
        object.__setattr__(self, "max_requests", self.max_requests or 1)
        object.__setattr__(self, "timeout", self.timeout or 60.0)


@dataclass(frozen=True)
class Breaker:
    state: str = CLOSED
    generation: int = 0
    counts: Counts = field(default_factory=Counts)
    expiry: float | None = None


def _renewed(b: Breaker, state: str, now: float, rule: BreakerRule) -> Breaker:
    expiry = now + rule.timeout if state == OPEN else now + rule.interval if state == CLOSED and rule.interval else None
    return Breaker(state, b.generation + 1, Counts(), expiry)


def breaker_at(b: Breaker, now: float, rule: BreakerRule) -> Breaker:
    """The breaker as time alone changes it."""
    if b.generation == 0 and b.expiry is None and b.state == CLOSED and rule.interval:
        b = replace(b, expiry=now + rule.interval)
    if b.expiry is not None and b.expiry < now:
        if b.state == CLOSED:
            return _renewed(b, CLOSED, now, rule)
        if b.state == OPEN:
            return _renewed(b, HALF_OPEN, now, rule)
    return b


def breaker_before(b: Breaker, now: float, rule: BreakerRule) -> tuple[Breaker, str]:
    """The verdict on a request: ``allowed``, ``open`` or ``too many``."""
    b = breaker_at(b, now, rule)
    if b.state == OPEN:
        return b, "open"
    if b.state == HALF_OPEN and b.counts.requests >= rule.max_requests:
        return b, "too many"
    return replace(b, counts=replace(b.counts, requests=b.counts.requests + 1)), "allowed"


def breaker_after(b: Breaker, generation: int, now: float, success: bool, rule: BreakerRule) -> Breaker:
    """The result of a request that was allowed in ``generation``; ignored if that is over."""
    b = breaker_at(b, now, rule)
    if b.generation != generation:
        return b
    c = b.counts
    if success:
        b = replace(b, counts=replace(c, successes=c.successes + 1, successes_in_row=c.successes_in_row + 1, failures_in_row=0))
        return _renewed(b, CLOSED, now, rule) if b.state == HALF_OPEN and b.counts.successes_in_row >= rule.max_requests else b
    if b.state == HALF_OPEN:
        return _renewed(b, OPEN, now, rule)
    b = replace(b, counts=replace(c, failures=c.failures + 1, failures_in_row=c.failures_in_row + 1, successes_in_row=0))
    return _renewed(b, OPEN, now, rule) if rule.should_trip(b.counts) else b


def breaker_call(b: Breaker, now: float, success: bool, rule: BreakerRule) -> tuple[Breaker, str]:
    """A request that ends at once."""
    b, verdict = breaker_before(b, now, rule)
    return (breaker_after(b, b.generation, now, success, rule) if verdict == "allowed" else b), verdict


@dataclass(frozen=True)
class Batcher:
    """Batch number, items in it, and when its time began."""

    batch: int = 0
    size: int = 0
    began: float | None = None


def batch_step(s: Batcher, now: float, count: int, timeout: float) -> tuple[Batcher, int]:
    """The batch that an item at ``now`` belongs to. A batch ends when it has ``count`` items or ``timeout`` after the flush before it; empty batches get no number."""
    began = now if s.began is None else s.began
    if now - began >= timeout:
        periods = int((now - began) // timeout)
        s = Batcher(s.batch + (s.size > 0), 0, began + periods * timeout)
    else:
        s = Batcher(s.batch, s.size, began)
    number = s.batch
    if s.size + 1 >= count:
        return Batcher(s.batch + 1, 0, now), number
    return Batcher(s.batch, s.size + 1, s.began), number


def deque_fold(ops: Iterable[tuple[str, object]]) -> tuple[list, list]:
    """The final deque and each operation's result, from ``push_left, push_right, pop_left, pop_right, remove`` in order."""
    d: deque = deque()
    results = []
    for op, value in ops:
        result = None
        if op == "push_left":
            d.appendleft(value)
        elif op == "push_right":
            d.append(value)
        elif op == "pop_left":
            result = d.popleft() if d else None
        elif op == "pop_right":
            result = d.pop() if d else None
        elif op == "remove":
            if value in d:
                d.remove(value)
                result = value
        else:
            raise ValueError(f"unknown operation {op}")
        results.append(result)
    return list(d), results


class LruCache:
    """Least recently used entries go first; 0 keeps all. ``purged`` collects what went."""

    def __init__(self, capacity: int):
        if capacity < 0:
            raise ValueError("the capacity must not be negative")
        self.capacity, self.items, self.purged = capacity, OrderedDict(), []

    def add(self, key, value) -> None:
        self.items[key] = value
        self.items.move_to_end(key)
        if self.capacity and len(self.items) > self.capacity:
            self.remove_oldest()

    def get(self, key):
        if key not in self.items:
            return None
        self.items.move_to_end(key)
        return self.items[key]

    def remove(self, key) -> None:
        if key in self.items:
            self.purged.append((key, self.items.pop(key)))

    def remove_oldest(self) -> None:
        if self.items:
            self.purged.append(self.items.popitem(last=False))

    def clear(self) -> None:
        self.purged += self.items.items()
        self.items.clear()

    def __len__(self) -> int:
        return len(self.items)


def backoff_exponential(base: float, cap: float, retries: int) -> float:
    return min(cap, 2.0 ** min(retries, 1000) * base)


class Backoff:
    """Delays by number of retries: ``exponential``, ``full``, ``equal`` or ``decorrelated`` jitter."""

    def __init__(self, base: float, cap: float, strategy: str = "exponential", seed: int | str = 0):
        if cap < base:
            raise ValueError("the cap is below the base")
        if strategy not in ("exponential", "full", "equal", "decorrelated"):
            raise ValueError(f"unknown strategy {strategy}")
        self.base, self.cap, self.strategy, self.random, self.before = base, cap, strategy, random.Random(seed), base

    def __call__(self, retries: int) -> float:
        e = backoff_exponential(self.base, self.cap, retries)
        if self.strategy == "full":
            return self.random.uniform(0, e)
        if self.strategy == "equal":
            return e / 2 + self.random.uniform(0, e / 2)
        if self.strategy == "decorrelated":
            if retries == 0:
                self.before = self.base
            self.before = min(self.cap, self.random.uniform(self.base, 3 * self.before))
            return self.before
        return e
