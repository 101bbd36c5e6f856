"""The skill dictionary as two small dimension tables.

A dictionary is a parameter: {canonical name: [other spellings]}, given as a
mapping or a JSON file.  ``DEFAULT_SKILLS`` is a small one of our own, to begin
with; real use brings its own file.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.text import norm_key, norm_key_of, singulars

#: Names of skills, by kind, and other spellings of them.
DEFAULT_SKILLS: dict[str, list[str]] = {
    # languages
    "SQL": ["structured query language", "ansi sql"],
    "Python": ["python3", "cpython"],
    "R": ["r language", "rstats"],
    "Java": ["jdk", "openjdk"],
    "Kotlin": [],
    "Scala": ["scala 3"],
    "JavaScript": ["ecmascript", "js"],
    "TypeScript": ["ts"],
    "C#": ["c sharp", "csharp"],
    "C++": ["cpp"],
    "Go": ["golang"],
    "Rust": ["rustlang"],
    # storage
    "PostgreSQL": ["postgres", "postgis"],
    "MySQL": ["mariadb"],
    "MongoDB": ["mongo"],
    "Redis": ["valkey"],
    "Snowflake": ["snowpark"],
    "BigQuery": ["google bigquery"],
    # movement of data
    "ETL": ["elt", "data pipeline", "data pipelines"],
    "Spark": ["apache spark", "pyspark"],
    "Kafka": ["apache kafka"],
    "Airflow": ["apache airflow"],
    "dbt": ["dbt core"],
    # machines and delivery
    "Linux": ["debian", "ubuntu"],
    "Docker": ["docker compose", "dockerfile"],
    "Kubernetes": ["k8s", "helm charts"],
    "Terraform": ["opentofu"],
    "AWS": ["amazon web services"],
    "Azure": ["microsoft azure"],
    "GCP": ["google cloud"],
    "Git": ["github", "gitlab"],
    "CI/CD": ["continuous integration", "continuous delivery", "continuous deployment"],
    "Jenkins": ["jenkinsfile"],
    "GitHub Actions": ["github workflows"],
    "REST API": ["rest apis", "restful api", "openapi"],
    "FastAPI": ["fast api"],
    "gRPC": ["protobuf"],
    "Microservices": ["micro services"],
    # analysis
    "Statistics": ["statistical analysis", "statistical inference"],
    "Machine Learning": ["ml"],
    "PyTorch": ["torch"],
    "NLP": ["natural language processing"],
    "Data Analysis": ["data analytics"],
    "Excel": ["ms excel", "spreadsheets"],
    "Power BI": ["powerbi"],
    "Tableau": ["tableau desktop"],
    # people
    "Communication": ["stakeholder management", "presentation skills"],
    "Leadership": ["team leadership", "people management"],
    "Project Management": ["programme management", "pmp"],
}
#: A table is broadcast only if it has at most so many rows.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class SkillDictionary:
    """Aliases (unique key to canonical name) and forms (canonical name to every spelling)."""

    skills: Mapping[str, list[str]]

    @classmethod
    def load(cls, path: str) -> SkillDictionary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def alias_rows(self) -> list[tuple[str, str]]:
        """Canonical names first, longest first; of aliases the first owner wins."""
        out: dict[str, str] = {norm_key_of(name): name for name in sorted(self.skills, key=len, reverse=True)}
        for name, aliases in self.skills.items():
            for alias in aliases:
                out.setdefault(norm_key_of(alias), name)
        return [(k, v) for k, v in out.items() if k]

    def form_rows(self) -> list[tuple[str, str, int, int]]:
        """(canonical, form key, words, order); order puts longer canonical names first."""
        out = []
        for order, name in enumerate(sorted(self.skills, key=len, reverse=True)):
            for key in dict.fromkeys(norm_key_of(f) for f in sorted({name, *self.skills[name]}, key=lambda f: (-len(f), f))):
                if key:
                    out.append((name, key, len(key.split()), order))
        return out

    def aliases(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.alias_rows(), "alias_key string, alias_canonical string")

    def forms(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.form_rows(), "form_canonical string, form_key string, form_words int, form_order int")

    def first_words(self, spark: SparkSession) -> DataFrame:
        """(first_word, form_key, canonical, canon_ord, before): every form by its first word, with the forms of the same name that come before it."""
        rows, before = [], {}
        for name, key, _, order in self.form_rows():
            rows.append((key.split()[0], key, name, order, list(before.setdefault(name, []))))
            before[name].append(key)
        return spark.createDataFrame(rows, "first_word string, form_key string, canonical string, canon_ord int, before array<string>")

    def size(self) -> int:
        return len(self.skills)

    def small(self, table: DataFrame, rows: int) -> DataFrame:
        """``table`` to broadcast if its known size allows."""
        return F.broadcast(table) if rows <= MOST_BROADCAST else table

    def with_canonical(self, df: DataFrame, name: Column, out: str = "canonical") -> DataFrame:
        """``df`` with the canonical name of ``name``: its key's, else that of its first known singular, else null."""
        rows = self.alias_rows()
        held = df.withColumn("_key", norm_key(name))
        held = held.withColumns({"_s0": F.col("_key")} | {f"_s{k}": s for k, s in enumerate(singulars(F.col("_key")), 1)})
        for k in range(4):
            table = self.aliases(df.sparkSession).select(F.col("alias_key").alias(f"_s{k}"), F.col("alias_canonical").alias(f"_c{k}"))
            held = held.join(self.small(table, len(rows)), f"_s{k}", "left")
        return held.withColumn(out, F.coalesce(*(f"_c{k}" for k in range(4)))).drop("_key", *(f"_{x}{k}" for x in "sc" for k in range(4)))


def shown(name: Column, canonical: Column) -> Column:
    """The canonical name, else the name itself with single spaces and a capital first letter."""
    plain = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    return F.coalesce(canonical, F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1_000_000)))


DEFAULT = SkillDictionary(DEFAULT_SKILLS)
