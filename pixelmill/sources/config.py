"""Settings from the environment: tuning profiles, stores."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

#: Fixed values, by setting: default without a profile, high_throughput, low_latency, memory_efficient. Processing and
#: pool sizes stand as multiples of the processors; None means "as many as processors".
PROFILES = {
    "max_concurrent_downloads": (20, 50, 10, 5),
    "max_concurrent_processing": (1.0, 2.0, 1.0, 0.5),
    "http_timeout_s": (30, 15, 10, 45),
    "max_image_mib": (50, 100, 20, 10),
    "cpu_pool": (None, 1.0, 1.0, 0.5),
    "enable_http2": (False, True, True, False),
    "connection_pool": (50, 100, 25, 10),
    "keep_alive_s": (60, 120, 30, 30),
}
NAMES = ("", "high_throughput", "low_latency", "memory_efficient")
BY_PROCESSORS = ("max_concurrent_processing", "cpu_pool")


@dataclass(frozen=True)
class Performance:
    max_concurrent_downloads: int = 20
    max_concurrent_processing: int | None = None
    http_timeout_s: int = 30
    max_image_mib: int = 50
    cpu_pool: int | None = None
    enable_http2: bool = True
    connection_pool: int = 50
    keep_alive_s: int = 60

    @property
    def max_image_bytes(self) -> int:
        return self.max_image_mib * 1024 * 1024

    def pool(self, processors: int | None = None) -> int:
        return self.cpu_pool if self.cpu_pool is not None else processors or os.cpu_count() or 1


def resolved(profile: str | None, given: Mapping[str, object] | None = None, processors: int | None = None) -> Performance:
    """A profile's values with what is given explicitly over them; unknown profiles count as none."""
    n = processors or os.cpu_count() or 1
    column = NAMES.index(profile.lower()) if profile and profile.lower() in NAMES else 0
    base = {k: v[column] for k, v in PROFILES.items()}
    for k in BY_PROCESSORS:
        base[k] = None if base[k] is None else int(n * base[k])
    return Performance(**base | {k: v for k, v in (given or {}).items() if v is not None})


def resolved_rows(df: DataFrame, profile: str, given: Mapping[str, str], processors: int) -> DataFrame:
    """``resolved`` for every row: the row's ``profile`` names it (in any case; others count as none), ``given`` maps settings to
    columns that hold explicit values or null. Adds all settings, and ``max_image_bytes`` and ``pool``."""
    name = F.coalesce(F.when(F.lower(profile).isin(*NAMES), F.lower(profile)), F.lit(""))
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v[0], bool) else 'int'}" for k, v in PROFILES.items())
    presets = [(n, *[getattr(resolved(n, processors=processors), k) for k in PROFILES]) for n in NAMES]
    table = df.sparkSession.createDataFrame(presets, f"__name string, {kinds}")
    met = df.withColumn("__name", name).join(F.broadcast(table.select("__name", *[F.col(k).alias(f"__{k}") for k in PROFILES])), "__name")
    met = met.withColumns({k: F.coalesce(*[F.col(c) for c in (given.get(k),) if c], F.col(f"__{k}")) for k in PROFILES})
    met = met.withColumns({"max_image_bytes": F.col("max_image_mib").cast("long") * 1024 * 1024, "pool": F.coalesce("cpu_pool", F.lit(processors))})
    return met.drop("__name", *[f"__{k}" for k in PROFILES])


#: The environment's names of the settings.
NAMES_IN_ENV = {
    "max_concurrent_downloads": "MAX_CONCURRENT_DOWNLOADS",
    "max_concurrent_processing": "MAX_CONCURRENT_PROCESSING",
    "http_timeout_s": "HTTP_TIMEOUT_SECS",
    "max_image_mib": "MAX_IMAGE_SIZE_MB",
    "cpu_pool": "CPU_THREAD_POOL_SIZE",
    "enable_http2": "ENABLE_HTTP2",
    "connection_pool": "CONNECTION_POOL_SIZE",
    "keep_alive_s": "KEEP_ALIVE_TIMEOUT_SECS",
}
#: The environment's other names, and what holds where they are not set.
SERVICE = {
    "host": ("HOST", "0.0.0.0"),
    "port": ("PORT", "3000"),
    "storage_type": ("STORAGE_TYPE", None),
    "sub_path": ("STORAGE_SUB_PATH", ""),
    "endpoint": ("MINIO_ENDPOINT_URL", "http://localhost:9000"),
    "access_key": ("MINIO_ACCESS_KEY_ID", "minioadmin"),
    "secret_key": ("MINIO_SECRET_ACCESS_KEY", "minioadmin"),
    "bucket": ("MINIO_BUCKET", "image-cache"),
    "region": ("MINIO_REGION", "us-east-1"),
    "local_path": ("LOCAL_FS_STORAGE_PATH", "./data/images"),
    "cdn_base": ("CDN_BASE_URL", "http://localhost:9000/image-cache"),
}


def from_env(env: Mapping[str, str] | None = None, processors: int | None = None) -> Performance:
    """``PERFORMANCE_PROFILE`` and the settings' own names; what cannot be read as the setting's kind is an error."""
    env = os.environ if env is None else env
    given: dict[str, object] = {}
    for name, said in NAMES_IN_ENV.items():
        raw = env.get(said)
        if raw:
            if name == "enable_http2" and raw.lower() not in ("true", "false"):
                raise ValueError(f"{said}: true or false, not {raw!r}")
            given[name] = raw.lower() == "true" if name == "enable_http2" else int(raw)
    return resolved(env.get("PERFORMANCE_PROFILE"), given, processors)


def service(env: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """The environment's other settings; the port is a number of 16 bits."""
    env = os.environ if env is None else env
    out = {name: env.get(said, default) for name, (said, default) in SERVICE.items()}
    if not (out["port"].isdigit() and int(out["port"]) < 65536):
        raise ValueError(f"PORT: not {out['port']!r}")
    return out


def stores(env: Mapping[str, str] | None = None, enabled: tuple[str, ...] = ("s3", "local", "memory")) -> Stores:
    """The enabled stores with their settings from the environment."""
    s = service(env)
    s3 = {k: s[k] for k in ("endpoint", "access_key", "secret_key", "bucket", "region", "sub_path")}
    return Stores(s3 if "s3" in enabled else None, s["local_path"] if "local" in enabled else None, "memory" in enabled, enabled)


@dataclass(frozen=True)
class Stores:
    """Which stores are enabled, and their settings (None: not configured)."""

    s3: Mapping[str, str] | None = None
    local: str | None = None
    memory: bool = False
    enabled: tuple[str, ...] = ()


KINDS = {n: kind for kind, names in {"s3": ("S3", "MINIO"), "local": ("LOCAL_FS", "LOCALFS", "LOCAL"), "memory": ("IN_MEMORY", "INMEMORY", "MEMORY")}.items() for n in names}


def store_kind(name: str) -> str:
    if name.upper() not in KINDS:
        raise ValueError(f"unknown store {name!r}")
    return KINDS[name.upper()]


def chosen(stores: Stores, configured: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """None enabled is an error; a single one is taken whatever is configured; else the configured name, then
    ``STORAGE_TYPE``, then the first of s3, local, memory. A chosen store must be enabled and have its settings."""
    env = os.environ if env is None else env
    if not stores.enabled:
        raise ValueError("no store is enabled")
    name = configured or env.get("STORAGE_TYPE")
    if len(stores.enabled) == 1:
        kind = stores.enabled[0]
    elif name:
        kind = store_kind(name)
    else:
        kind = next(k for k in ("s3", "local", "memory") if k in stores.enabled)
    if kind not in stores.enabled:
        raise ValueError(f"store {kind} is not enabled")
    if kind == "s3" and not stores.s3 or kind == "local" and not stores.local:
        raise ValueError(f"store {kind} has no settings")
    return kind


def hadoop_settings(s3: Mapping[str, str]) -> dict[str, str]:
    """Settings of the s3a file system: endpoint, path-style access, static credentials."""
    return {
        "spark.hadoop.fs.s3a.endpoint": s3["endpoint"],
        "spark.hadoop.fs.s3a.path.style.access": "true",
        "spark.hadoop.fs.s3a.access.key": s3["access_key"],
        "spark.hadoop.fs.s3a.secret.key": s3["secret_key"],
        **({"spark.hadoop.fs.s3a.endpoint.region": s3["region"]} if s3.get("region") else {}),
    }


def store_path(stores: Stores, kind: str) -> str:
    return f"s3a://{stores.s3['bucket']}/{stores.s3.get('sub_path', '')}" if kind == "s3" else str(stores.local)


def with_pool(p: Performance, processors: int | None = None) -> Performance:
    return replace(p, cpu_pool=p.pool(processors))
