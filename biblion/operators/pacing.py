"""One clock and one breaker for calls of all tasks: a small lease service on the driver.

Calling tasks ask it before every attempt. It grants a provider's starts one after the other,
each no sooner than the interval after the one before has begun: a task acknowledges
its start, and the interval runs from there, so neither the number of tasks, nor retries, nor
slow connections bring two starts closer. A provider that has refused (401, 403) is closed: no
task's further attempt is granted. The service holds a few numbers, whatever the input; if a
task dies with a grant, the next one follows after ``ACK_S``.
"""

from __future__ import annotations

import secrets
import socket
import socketserver
import threading
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import TaskContext
from pyspark.sql import SparkSession

#: Seconds that the service waits for a task to acknowledge, and a task for its turn.
ACK_S, TURN_S = 2.0, 3600.0
_ADDRESS = "biblion.calling.lease"


class Refused(Exception):
    """The provider is closed for the run."""


class Lost(OSError):
    """The lease service does not answer: the task must not go on without it."""


class _Service(socketserver.ThreadingTCPServer):
    daemon_threads, allow_reuse_address = True, True
    request_queue_size = 256

    def __init__(self, host: str, intervals: dict[str, float]):
        super().__init__((host, 0), _Handler)
        self.token, self.intervals = secrets.token_hex(16), intervals
        self.turn: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
        self.guard = threading.Lock()
        self.next: dict[str, float] = {}
        self.closed: set[str] = set()

    def turn_of(self, name: str) -> threading.Lock:
        with self.guard:
            return self.turn[name]


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        service: _Service = self.server
        if self.rfile.readline(256).decode().strip() != service.token:
            return
        while line := self.rfile.readline(256).decode().split():
            verb, name = line
            if verb == "close":
                service.closed.add(name)
                self._say("ok")
            elif not self._grant(service, name):
                return

    def _say(self, word: str) -> None:
        self.wfile.write(f"{word}\n".encode())

    def _grant(self, service: _Service, name: str) -> bool:
        interval = service.intervals.get(name, 0.0)
        if not interval:
            self._say("stop" if name in service.closed else "go")
            return True
        with service.turn_of(name):
            while name not in service.closed and (left := service.next.get(name, 0.0) - time.monotonic()) > 0:
                time.sleep(min(left, 0.2))
            if name in service.closed:
                self._say("stop")
                return True
            try:
                self._say("go")
                self.connection.settimeout(ACK_S)
                alive = bool(self.rfile.readline(16))
                self.connection.settimeout(None)
            except OSError:
                alive = False
            service.next[name] = time.monotonic() + interval
        return alive


class Gate:
    """A provider's clock and breaker as a task sees them."""

    def __init__(self, address: str, name: str):
        self.address, self.name, self.file = address, name, None

    def _ask(self, verb: str) -> str:
        try:
            return self._asked(verb)
        except OSError as e:
            raise Lost("the lease service does not answer") from e

    def _asked(self, verb: str) -> str:
        if self.file is None:
            host, port, token = self.address.rsplit(":", 2)
            connection = socket.create_connection((host, int(port)), timeout=TURN_S)
            connection.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            self.file = connection.makefile("rwb", buffering=0)
            self._tell(token)
        self._tell(f"{verb} {self.name}")
        answer = self.file.readline().decode().strip()
        if not answer:
            raise ConnectionError("closed")
        return answer

    def _tell(self, line: str) -> None:
        self.file.write(f"{line}\n".encode())

    def wait(self) -> None:
        """Return when an attempt may start; raise ``Refused`` if none may any more."""
        if self._ask("start") == "stop":
            raise Refused(self.name)
        self._tell("on")

    def refuse(self) -> None:
        """Close the provider for all tasks."""
        self._ask("close")


class Free(Gate):
    """A provider without an interval: its attempts start at once, unless it is closed."""

    def wait(self) -> None:
        if self._ask("start") == "stop":
            raise Refused(self.name)


class Spaced:
    """The same within one process, where no service runs; ``share`` processes split the rate."""

    def __init__(self, interval: float = 0.0, share: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.closed = interval * share, clock, sleep, 0.0, False

    def wait(self) -> None:
        if self.closed:
            raise Refused
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap

    def refuse(self) -> None:
        self.closed = True


@contextmanager
def leased(spark: SparkSession, intervals: dict[str, float]) -> Iterator[None]:
    """Within the block, tasks of this thread's jobs share the clocks of ``intervals`` (provider -> seconds; others
    have a breaker only). A block within another uses the outer one's."""
    context = spark.sparkContext
    if context.getLocalProperty(_ADDRESS):
        yield
        return
    local = context.master.startswith("local")
    service = _Service("127.0.0.1" if local else spark.conf.get("spark.driver.bindAddress", "0.0.0.0"), intervals)
    host = "127.0.0.1" if local else spark.conf.get("spark.driver.host")
    threading.Thread(target=service.serve_forever, daemon=True).start()
    context.setLocalProperty(_ADDRESS, f"{host}:{service.server_address[1]}:{service.token}")
    try:
        yield
    finally:
        context.setLocalProperty(_ADDRESS, None)
        service.shutdown()
        service.server_close()


def gate(name: str, interval: float = 0.0) -> Gate | Spaced:
    """The provider's gate in this task; outside a leased block one of this process alone."""
    context = TaskContext.get()
    address = context.getLocalProperty(_ADDRESS) if context else None
    if not address:
        return Spaced(interval)
    return Gate(address, name) if interval else Free(address, name)
