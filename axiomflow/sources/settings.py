"""Settings from a properties file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from axiomflow.plans.placement import WEIGHTS


def parse_properties(text: str) -> dict[str, str]:
    """key = value or key: value lines; # and ! begin comments; a backslash at the end goes on to the next line."""
    out, held = {}, ""
    for raw in text.splitlines():
        line = held + raw.strip()
        held = ""
        if not line or line[0] in "#!":
            continue
        if line.endswith("\\"):
            held = line[:-1]
            continue
        at = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
        out[line[:at].strip()] = line[at + 1 :].strip()
    return out


@dataclass
class Settings:
    """What a job may set; all have defaults."""

    max_rounds: int = 10_000
    shuffle_partitions: int | None = None
    instrument: bool = False
    base_file: str = ""
    chunk_rows: int = 200_000
    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))

    @staticmethod
    def of(values: dict[str, str]) -> Settings:
        s = Settings()
        s.max_rounds = int(values.get("max.rounds", s.max_rounds))
        s.shuffle_partitions = int(values["shuffle.partitions"]) if "shuffle.partitions" in values else None
        s.instrument = values.get("instrument", "false").lower() == "true"
        s.base_file = values.get("base.file", "")
        s.chunk_rows = int(values.get("chunk.rows", s.chunk_rows))
        for item in filter(None, values.get("weights", "").split(",")):
            rule, _, n = item.partition(":")
            s.weights[rule.strip()] = int(n)
        return s

    @staticmethod
    def read(spark: SparkSession, path: str) -> Settings:
        text = spark.read.text(path, wholetext=True).first()
        return Settings.of(parse_properties(text.value if text else ""))

    def apply(self, spark: SparkSession) -> None:
        if self.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", self.shuffle_partitions)
