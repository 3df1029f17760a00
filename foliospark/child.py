"""A function in a process of its own, which can be ended at a time limit. main() is what that process runs."""

from __future__ import annotations

import os
import pickle
import selectors
import struct
import subprocess
import sys
import time


class TookTooLong(Exception):
    """The call was ended at its limit."""


class Died(Exception):
    """The process ended without an answer."""


def _send(out, value: bytes) -> None:
    out.write(struct.pack("<Q", len(value)) + value)
    out.flush()


def _receive(source) -> bytes | None:
    head = source.read(8)
    return source.read(struct.unpack("<Q", head)[0]) if len(head) == 8 else None


class Child:
    """Calls a function in one child process after the other: a process serves call after call until one exceeds its limit.

    At the limit the process is killed, with all that it does, and the next call starts a new one. What the function raises is
    raised here as it is, if it can be sent, else as Died. A context manager: the process ends with it.
    """

    #: Seconds for a process to start and take the function, which don't count as the call's.
    START_S = 60.0

    def __init__(self, function):
        from pyspark import cloudpickle

        self.code = cloudpickle.dumps(function)
        self.process: subprocess.Popen | None = None

    def __enter__(self) -> Child:
        return self

    def __exit__(self, *_) -> None:
        self.end()

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            for pipe in (self.process.stdin, self.process.stdout):
                try:
                    pipe.close()
                except OSError:  # what was still to be written has no reader
                    pass
            self.process = None

    def _start(self) -> None:
        paths = {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.process = subprocess.Popen([sys.executable, "-c", "from foliospark.child import main; main()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | paths)
        self._exchange(self.code, self.START_S)

    def _exchange(self, sent: bytes, limit_s: float) -> bytes:
        until = time.monotonic() + limit_s
        try:
            _send(self.process.stdin, sent)
        except BrokenPipeError:
            self.end()
            raise Died("the process has ended") from None
        found, wanted, source = b"", 8, self.process.stdout.fileno()
        with selectors.DefaultSelector() as ready:
            ready.register(source, selectors.EVENT_READ)
            while len(found) < wanted:
                if not ready.select(max(0.0, until - time.monotonic())):
                    self.end()
                    raise TookTooLong(f"no answer within {limit_s:g} s")
                part = os.read(source, min(1 << 20, wanted - len(found)))
                if not part:
                    self.end()
                    raise Died("the process has ended")
                found += part
                if wanted == 8 and len(found) == 8:
                    wanted = 8 + struct.unpack("<Q", found)[0]
        return found[8:]

    def call(self, values: tuple, limit_s: float):
        """function(*values), or what it raises; TookTooLong at the limit."""
        if self.process is None:
            self._start()
        fine, answer = pickle.loads(self._exchange(pickle.dumps(values), limit_s))
        if not fine:
            raise answer
        return answer


def main() -> None:
    """Takes a function, then values, and answers each. What the function prints goes to the error stream."""
    source, out = sys.stdin.buffer, os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)
    function = pickle.loads(_receive(source))
    _send(out, b"ready")
    while (given := _receive(source)) is not None:
        try:
            answer = (True, function(*pickle.loads(given)))
        except Exception as problem:  # whatever a model's client raises
            answer = (False, problem)
        try:
            sent = pickle.dumps(answer)
            pickle.loads(sent)
        except Exception:  # an error or answer that can't cross
            sent = pickle.dumps((False, Died(f"{type(answer[1]).__name__}: {answer[1]}")))
        _send(out, sent)
