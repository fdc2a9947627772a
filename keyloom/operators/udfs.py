"""User functions: libraries that can be loaded, listed, called and dropped by name."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Registry:
    """Libraries of functions on DataFrames (a stored procedure), and SQL functions by the digest of their text."""

    spark: SparkSession
    libraries: dict[str, dict[str, Callable[..., DataFrame]]] = field(default_factory=dict)
    scripts: dict[str, str] = field(default_factory=dict)

    def load(self, library: str, functions: dict[str, Callable[..., DataFrame]], replace: bool = False) -> None:
        if library in self.libraries and not replace:
            raise ValueError(f"library {library} exists")
        taken = {f for name, fs in self.libraries.items() if name != library for f in fs}
        if taken & set(functions):
            raise ValueError(f"functions exist: {sorted(taken & set(functions))}")
        self.libraries[library] = dict(functions)

    def delete(self, library: str) -> None:
        del self.libraries[library]

    def flush(self) -> None:
        self.libraries.clear()

    def list(self) -> list[tuple[str, str]]:
        return sorted((name, f) for name, fs in self.libraries.items() for f in fs)

    def stats(self) -> dict[str, int]:
        return {"libraries": len(self.libraries), "functions": len(self.list())}

    def call(self, name: str, *args: object, **options: object) -> DataFrame:
        for fs in self.libraries.values():
            if name in fs:
                return fs[name](*args, **options)
        raise KeyError(f"no function {name}")

    call_ro = call

    def dump(self) -> bytes:
        """All libraries as bytes, to be restored in another session; not safe to restore from others."""
        return cloudpickle.dumps(self.libraries)

    def restore(self, blob: bytes, policy: str = "append") -> None:
        """Libraries of a dump: added (one that exists is an error), replacing those of their name, or after a flush."""
        found = pickle.loads(blob)
        if policy not in ("append", "replace", "flush"):
            raise ValueError("policy must be append, replace or flush")
        if policy == "flush":
            self.flush()
        for library, functions in found.items():
            self.load(library, functions, replace=policy == "replace")

    def script_load(self, sql: str) -> str:
        """Keep a SQL text with :named parameters; returns its SHA-1."""
        sha = hashlib.sha1(sql.encode()).hexdigest()
        self.scripts[sha] = sql
        return sha

    def script_exists(self, *shas: str) -> list[int]:
        return [int(s in self.scripts) for s in shas]

    def script_flush(self) -> None:
        self.scripts.clear()

    def eval(self, sql: str, **args: object) -> DataFrame:
        return self.spark.sql(sql, args=args or None)

    def evalsha(self, sha: str, **args: object) -> DataFrame:
        if sha not in self.scripts:
            raise KeyError("no such script")
        return self.eval(self.scripts[sha], **args)
