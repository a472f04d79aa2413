"""The few spellings in which Spark SQL and plain SQL (DuckDB) differ, so that a formula is stated once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def div(self, a: str, b: str) -> str:
        """Integer division, towards zero."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def shr(self, a: str, n: str) -> str:
        """Arithmetic shift to the right."""
        return f"shiftright(cast({a} as bigint), cast({n} as int))" if self.spark else f"(cast({a} as bigint) >> cast({n} as int))"

    def shl(self, a: str, n: str) -> str:
        return f"shiftleft(cast({a} as bigint), cast({n} as int))" if self.spark else f"(cast({a} as bigint) << cast({n} as int))"

    def wrap32(self, a: str) -> str:
        """The low 32 bits as a signed number; in 64-bit arithmetic, since ANSI casts would raise."""
        return f"(((({a}) + 2147483648) & 4294967295) - 2147483648)"

    def floor_log2(self, a: str) -> str:
        """For whole a > 0; exact, unlike a logarithm."""
        return f"(length(bin(cast({a} as bigint))) - 1)"

    def real(self, a: str) -> str:
        return f"cast({a} as double)"

    def table(self, name: str, sf_dir: str = "") -> str:
        return f"parquet.`{sf_dir}/{name}.parquet`" if self.spark else name


SPARK, PLAIN = Dialect(True), Dialect(False)
