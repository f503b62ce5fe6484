"""Named objects that handlers use: started and stopped with the engine, and handed to those that ask for their type."""

from __future__ import annotations

import inspect
import warnings
from typing import get_type_hints

from rivulet.exceptions import RegistrationError


class Services:
    def __init__(self):
        self.named: dict[str, object] = {}
        self.groups: dict[str, list[str]] = {}
        self.running = False

    def register(self, name: str, service: object, group: str | None = None) -> None:
        """A service of a group is a worker's; groups start one after the other. One that comes while services run is started at once."""
        if name in self.named:
            raise RegistrationError(f"service {name} is there already")
        self.named[name] = service
        self.groups.setdefault(group or "", []).append(name)
        if self.running:
            _call(service, "start")

    def remove(self, name: str) -> object:
        if name not in self.named:
            raise RegistrationError(f"no service {name}")
        service = self.named.pop(name)
        for own in self.groups.values():
            if name in own:
                own.remove(name)
        if self.running:
            _call(service, "stop")
        return service

    def start(self) -> None:
        """start() of all, plain services before workers; then start_complete()."""
        if not self.running:
            self.running = True
            order = [self.named[n] for g in sorted(self.groups) for n in self.groups[g]]
            for step in ("start", "start_complete"):
                for service in order:
                    _call(service, step)

    def stop(self) -> None:
        if self.running:
            self.running = False
            for service in reversed(list(self.named.values())):
                _call(service, "stop")

    def matching(self, kind: type) -> list[tuple[str, object]]:
        """Services of the type, those of exactly this type first."""
        fits = [(n, s) for n, s in self.named.items() if isinstance(s, kind)]
        return sorted(fits, key=lambda x: type(x[1]) is not kind)

    def inject(self, target: object) -> int:
        """Calls target's ``use_...(service)`` or ``use_...(service, name)`` methods with every service of the annotated type; how many calls."""
        calls = 0
        for name, method in inspect.getmembers(target, callable):
            if name.startswith("use_"):
                hints = {k: v for k, v in get_type_hints(method).items() if k != "return"}
                wanted = list(inspect.signature(method).parameters)
                if wanted and isinstance(hints.get(wanted[0]), type) and len(wanted) <= 2:
                    for service_name, service in self.matching(hints[wanted[0]]):
                        method(*(service, service_name)[: len(wanted)])
                        calls += 1
        return calls

    def warn_of_orphans(self, feeds: dict) -> list[str]:
        """Services that are sources (they have a ``stream``) but no feed's: nothing will ever read them."""
        used = {id(getattr(f, "source", None)) for f in feeds.values()}
        orphans = [n for n, s in self.named.items() if hasattr(s, "stream") and id(s) not in used]
        for name in orphans:
            warnings.warn(f"service {name} is a source, but no feed reads it", stacklevel=2)
        return orphans


def _call(service: object, step: str) -> None:
    if callable(f := getattr(service, step, None)):
        f()
