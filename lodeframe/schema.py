"""Schemas and settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

CHUNK = "id string, text string, vector array<float>, sessionFile string, project string, lineNumber int, timestamp string, role string, source string, metadata map<string,string>"
CHUNK_COLUMNS = ["id", "text", "vector", "sessionFile", "project", "lineNumber", "timestamp", "role", "source", "metadata"]
PAYLOAD = [c for c in CHUNK_COLUMNS if c not in ("id", "vector")]

#: Chunk size and overlap in UTF-16 units by note folder.
FOLDER_LIMITS = {
    "meta": (6000, 400),
    "bib": (4800, 300),
    "notes": (4000, 300),
    "journal": (3200, 200),
    "botlog": (4000, 300),
    "llmlog": (3200, 200),
    "office": (4000, 300),
    "default": (4000, 300),
}
#: Folders that are indexed, directories that are passed over, dimensions of vectors.
INDEXED_FOLDERS = ("meta", "bib", "notes", "journal", "botlog")
SKIPPED_DIRS = (".git", "node_modules", ".agent-shell", "setup", "archives")
VALID_DIMS = (768, 1536, 3072)
SESSION_DIM, NOTE_DIM = 3072, 768


@dataclass(frozen=True)
class RetrieverConfig:
    vector_weight: float = 0.7
    text_weight: float = 0.3
    half_life_days: float = 90.0
    min_score: float = 0.05
    mmr: bool = True
    mmr_lambda: float = 0.7
    strategy: str = "weighted"
    rrf_k: int = 60
    parse_org_dates: bool = False
    rerank_top: int = 10

    def but(self, **changes) -> RetrieverConfig:
        return replace(self, **changes)


SESSION_CONFIG = RetrieverConfig(strategy="rrf", half_life_days=14.0, min_score=0.001, mmr=False)
NOTE_CONFIG = RetrieverConfig()


@dataclass(frozen=True)
class Paths:
    """Where sessions, notes and stores are; from the environment, else under HOME."""

    home: str = field(default_factory=lambda: os.environ.get("HOME", ""))
    data: str = field(default_factory=lambda: os.environ.get("LODEFRAME_DATA", ""))

    @property
    def data_dir(self) -> str:
        return self.data or f"{self.home}/.lodeframe"

    @property
    def session_store(self) -> str:
        return f"{self.data_dir}/sessions"

    @property
    def note_store(self) -> str:
        return f"{self.data_dir}/notes"

    @property
    def pi_sessions(self) -> str:
        return f"{self.home}/.pi/agent/sessions"

    @property
    def claude_sessions(self) -> str:
        return f"{self.home}/.claude/projects"

    @property
    def notes(self) -> str:
        return f"{self.home}/sync/org"


def configure(spark: SparkSession) -> SparkSession:
    """Session settings that the semantics rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark
