"""Typed reading of configuration."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Generic, TypeVar

from rivulet.exceptions import ConfigurationError

T = TypeVar("T")


@dataclass(frozen=True)
class ConfigKey(Generic[T]):
    name: str
    type: type[T]


class ConfigMap:
    """Values by key; keys with a type refuse values of another one."""

    def __init__(self, values: dict[str, Any]):
        self.values = dict(values)

    def get(self, key: ConfigKey[T] | str, default: T | None = None) -> T | None:
        if isinstance(key, str):
            return self.values.get(key, default)
        value = self.values.get(key.name)
        if value is None:
            return default
        if not isinstance(value, key.type):
            raise ConfigurationError(f"{key.name} is {type(value).__name__}, not {key.type.__name__}")
        return value

    def require(self, key: ConfigKey[T]) -> T:
        value = self.get(key)
        if value is None:
            raise ConfigurationError(f"{key.name} is missing")
        return value
