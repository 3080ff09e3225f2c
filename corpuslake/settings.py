"""Settings from the environment: connections as Spark options, names for URLs (S14, F32), and checks of requests.

Nothing connects here: Spark's own JDBC and object store clients take the options.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import NamedTuple
from urllib.parse import quote

PREFIX = "CORPUSLAKE_"
SOURCE_TYPES = ("video", "audio", "text")


class Settings(NamedTuple):
    """Where the database, the object store and the scheduler are; each field from PREFIX and its name in upper case."""

    database_host: str = "localhost"
    database_port: str = "5432"
    database_name: str = "lake"
    database_user: str = ""
    database_password: str = ""
    objects_endpoint: str = ""
    objects_user: str = ""
    objects_password: str = ""
    scheduler_url: str = "http://localhost:4200/api"
    scheduler_flow: str = "bronze-ingestion"
    scheduler_deployment: str = "default"
    scheduler_timeout: str = "10"

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings of an environment, this process's by default."""
        env = os.environ if env is None else env
        return cls(**{f: env[PREFIX + f.upper()] for f in cls._fields if PREFIX + f.upper() in env})

    def jdbc(self, table: str) -> dict[str, str]:
        """Options of spark.read.format("jdbc") for a table of the database."""
        return {"url": f"jdbc:postgresql://{self.database_host}:{int(self.database_port)}/{quote(self.database_name, safe='')}", "dbtable": table, "user": self.database_user, "password": self.database_password}

    def objects(self) -> dict[str, str]:
        """Configuration of build_session() for an object store behind s3a:// paths; none without an endpoint."""
        if not self.objects_endpoint:
            return {}
        secure = "true" if self.objects_endpoint.startswith("https://") else "false"
        s3a = {"endpoint": self.objects_endpoint, "access.key": self.objects_user, "secret.key": self.objects_password, "path.style.access": "true", "connection.ssl.enabled": secure}
        return {f"spark.hadoop.fs.s3a.{k}": v for k, v in s3a.items()}

    def deployment_url(self) -> str:
        """The scheduler's address of the deployment; names are quoted whole, slashes too."""
        return f"{self.scheduler_url.rstrip('/')}/deployments/name/{quote(self.scheduler_flow, safe='')}/{quote(self.scheduler_deployment, safe='')}"


def checked(source: str, options: dict) -> dict:
    """The options of a request to ingest ``source``, if they may be asked for; a ValueError names the first that may not.

    A single item needs a location and a known type; a crawl needs seeds and keywords, a depth of 2 to 5
    and 1 to 500 pages where they are given.
    """

    def ask(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{source}: {what}")

    def within(name: str, low: int, high: int) -> None:
        value = options.get(name)
        ask(value is None or (isinstance(value, int) and not isinstance(value, bool) and low <= value <= high), f"{name} is to be a whole number from {low} to {high}")

    if source == "single":
        ask(bool(str(options.get("location") or "").strip()), "a location is needed")
        ask(options.get("source_type") in SOURCE_TYPES, f"source_type is to be one of {', '.join(SOURCE_TYPES)}")
    elif source == "crawl":
        for name in ("seed_urls", "keywords"):
            given = options.get(name)
            ask(isinstance(given, list) and bool(given) and all(isinstance(x, str) and x.strip() for x in given), f"{name} is to be a list of one string or more")
        within("max_depth", 2, 5)
        within("max_pages", 1, 500)
    return {k: v for k, v in options.items() if v is not None}
