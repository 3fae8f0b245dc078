"""A log of paid answers, written before anything else is done with them.

A task that dies takes what it hasn't returned with it, and Spark asks a second task to do the
same work, after the first has failed or, with speculation, beside it. So each answer is one small
file, put in its place whole and once: the first that is there stands. Before a chunk is asked, it
is claimed by a file too, numbered by attempt, so that two tasks don't pay for one chunk. Tasks
that hold claims give signs of life; a claim whose task has given none for a while is superseded
by the next number. No clocks are compared: who waits watches the signs change.

Files are reached by ``pyarrow``, so local and mounted folders, HDFS and the usual object stores
will do. Where a store can't refuse to replace a file, two tasks may claim one chunk in the same
moment and both ask; the answer that stands is one all the same.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs as pafs

#: Seconds without a sign of life after which a claim is void.
LEASE = 15.0


@dataclass(frozen=True)
class AnswerLog:
    """Where answers are, for sending to tasks; each makes a ``Writer`` of its own."""

    uri: str
    lease: float = LEASE

    def check(self) -> None:
        """Raises if files can't be written there; for the driver, before anything is asked."""
        with self.writer():
            pass

    def writer(self) -> Writer:
        return Writer(self)


class Writer:
    """One task's access to the log; use as a context."""

    def __init__(self, log: AnswerLog):
        self.log, self.owner = log, uuid.uuid4().hex
        self.fs, self.base = pafs.FileSystem.from_uri(log.uri)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.signs: dict[str, tuple[str | None, float]] = {}
        self.dead: set[str] = set()
        self.ended = threading.Event()
        self.beating: threading.Thread | None = None

    def __enter__(self) -> Writer:
        self.fs.create_dir(f"{self.base}/owners", recursive=True)
        self.beat(0)
        self.beating = threading.Thread(target=self.beats, daemon=True)
        self.beating.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.beating.join()
        self.fs.delete_file(self.sign(self.owner))

    def sign(self, owner: str) -> str:
        return f"{self.base}/owners/{owner}"

    def beat(self, n: int) -> None:
        with self.fs.open_output_stream(self.sign(self.owner)) as out:
            out.write(str(n).encode())

    def beats(self) -> None:
        n = 0
        while not self.ended.wait(self.log.lease / 4):
            n += 1
            try:
                self.beat(n)
            except OSError:  # the next one may get through; if none does, the claims are void
                continue

    def folder(self, key: str) -> str:
        return f"{self.base}/{key[:2]}/{key}"

    def read(self, path: str) -> str | None:
        try:
            with self.fs.open_input_stream(path) as found:
                return found.read().decode()
        except FileNotFoundError:
            return None

    def publish(self, path: str, text: str) -> bool:
        """Put a whole file in place; False if there is one."""
        temporary = f"{self.base}/owners/{self.owner}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            out.write(text.encode())
        try:
            if self.local:
                os.link(temporary, path)  # refuses to replace
                return True
            if self.fs.get_file_info(path).type != pafs.FileType.NotFound:
                return False
            self.fs.move(temporary, path)
            return True
        except FileExistsError:
            return False
        finally:
            if self.fs.get_file_info(temporary).type != pafs.FileType.NotFound:
                self.fs.delete_file(temporary)

    def answer_of(self, key: str) -> dict | None:
        found = self.read(f"{self.folder(key)}/answer")
        return json.loads(found) if found else None

    def is_dead(self, owner: str) -> bool:
        if owner in self.dead:
            return True
        sign, now = self.read(self.sign(owner)), time.monotonic()
        if owner not in self.signs or self.signs[owner][0] != sign:
            self.signs[owner] = sign, now
        if sign is None or now - self.signs[owner][1] > self.log.lease:
            self.dead.add(owner)
        return owner in self.dead

    def take(self, key: str, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, int]:
        """(answer, 0) if there is one, or (None, attempt) if this task is the one to ask. Waits for who is asking."""
        folder = self.folder(key)
        self.fs.create_dir(folder, recursive=True)
        while True:
            found = self.answer_of(key)
            if found:
                return found, 0
            names = [i.base_name for i in self.fs.get_file_info(pafs.FileSelector(folder))]
            last = max((int(n.removeprefix("claim-")) for n in names if n.startswith("claim-")), default=0)
            held_by = self.read(f"{folder}/claim-{last:06d}") if last else None
            if held_by and held_by != self.owner and not self.is_dead(held_by):
                sleep(self.log.lease / 20)
            elif self.publish(f"{folder}/claim-{last + 1:06d}", self.owner):
                return None, last + 1

    def put(self, key: str, attempt: int, raw: str, attempts: int) -> dict:
        """Log an answer; returns the one that stands, which may be another attempt's."""
        mine = {"raw": raw, "attempts": attempts, "attempt": attempt}
        return mine if self.publish(f"{self.folder(key)}/answer", json.dumps(mine)) else self.answer_of(key)
