"""DuckDB SQL for the queries that SQL can express."""

from strataquill.llm import op05_mix, op06_decontaminate, op10_quality

ORACLES: dict[str, str] = {"op5_mix": op05_mix.ORACLE, "op6_decontaminate": op06_decontaminate.ORACLE, "op10_quality": op10_quality.ORACLE}
