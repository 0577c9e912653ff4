"""Progress of a streaming index run: files, rows, rate, time left."""

from __future__ import annotations

import json

from pyspark.sql.streaming import StreamingQueryListener


class IndexProgress(StreamingQueryListener):
    """Collects what each batch did; add it with spark.streams.addListener()."""

    def __init__(self, total_files: int | None = None):
        self.total_files, self.files, self.seconds, self.errors = total_files, 0, 0.0, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        done = json.loads(event.progress.json)
        self.files += done["numInputRows"]
        self.seconds += done.get("durationMs", {}).get("triggerExecution", 0) / 1000

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.errors.append(event.exception)

    @property
    def rate(self) -> float:
        """Files a second so far."""
        return self.files / self.seconds if self.seconds else 0.0

    @property
    def seconds_left(self) -> float | None:
        if self.total_files is None or not self.rate:
            return None
        return max(0, self.total_files - self.files) / self.rate

    def line(self) -> str:
        of = f"/{self.total_files}" if self.total_files is not None else ""
        left = "" if self.seconds_left is None else f", {self.seconds_left:.0f} s left"
        return f"{self.files}{of} files, {self.rate:.1f}/s{left}, {len(self.errors)} errors"
