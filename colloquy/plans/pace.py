"""How fast calls are made: a token bucket, shared by the calls that one task has in flight."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class TokenBucket:
    """At most ``burst`` + ``rate`` x T calls in any T seconds; ``wait`` holds all of them back.

    ``rate`` None is no limit, but waits are honoured. Calls get their turn in the order they come.
    """

    def __init__(self, rate: float | None, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate is not None and rate <= 0 or burst < 1:
            raise ValueError("a rate has to be above 0 and a burst 1 at least")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.lock = threading.Lock()
        self.tokens, self.at, self.closed_until = float(burst), clock(), 0.0

    def take(self) -> None:
        """Returns when the next call may be made."""
        while True:
            with self.lock:
                now = self.clock()
                pause = self.closed_until - now
                if pause <= 0:
                    if self.rate is None:
                        return
                    self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
                    self.at = now
                    if self.tokens >= 1 - 1e-9:
                        self.tokens -= 1
                        return
                    pause = (1 - self.tokens) / self.rate
            self.sleep(pause)

    def wait(self, seconds: float) -> None:
        """No call before so many seconds have passed; what was saved up until then is gone."""
        with self.lock:
            self.closed_until = max(self.closed_until, self.clock() + seconds)
            self.tokens, self.at = 0.0, self.closed_until
