"""Source files as tables: hashes, line counts, and the digest of a folder."""
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import BundleError

# Folders that are never source.
NO_SOURCE = ["__pycache__", "node_modules", "venv", "dist", "build"]
NO_SNAPSHOT = {".git", ".venv", "node_modules"}


def document(path) -> dict:
    """A specification: JSON by its ending, else YAML; its root must be an object."""
    path = Path(path).expanduser().resolve()
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as e:
        raise BundleError(f"cannot read {path}: {e}") from e
    try:
        if path.suffix.lower() == ".json":
            value = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as e:
                raise BundleError("YAML needs PyYAML; write the specification as JSON") from e
            value = yaml.safe_load(text)
    except BundleError:
        raise
    except Exception as e:
        raise BundleError(f"{path.name} cannot be parsed: {e}") from e
    if not isinstance(value, dict):
        raise BundleError(f"the root of {path.name} must be an object")
    return value


def _text(content):
    """The bytes as characters one by one, with line ends made one where the file is text."""
    t = F.decode(content, "ISO-8859-1")
    return F.when(F.contains(t, F.lit("\u0000")), t).otherwise(F.replace(t, F.lit("\r\n"), F.lit("\n")))


def evidence_files(spark: SparkSession, root, paths: list) -> DataFrame:
    """path, content_hash (64 hex digits), n_lines (null for binary files) of files below root. Outside or missing ones raise."""
    root = Path(root).resolve()
    for p in paths:
        parts = Path(p).parts
        if Path(p).is_absolute() or ".." in parts or not (root / p).resolve().is_relative_to(root):
            raise BundleError(f"the evidence path {p!r} must stay below the specification")
        if not (root / p).is_file():
            raise BundleError(f"there is no evidence file {p}")
    if not paths:
        return spark.createDataFrame([], "path string, content_hash string, n_lines int")
    where = spark.createDataFrame([((root / p).as_uri(), p) for p in paths], "uri string, path string")
    d = spark.read.format("binaryFile").load([str(root / p) for p in sorted(set(paths))]).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), _text(F.col("content")).alias("t"))
    lines = F.size(F.split(F.regexp_replace("t", r"[\r\n]\z", ""), r"[\r\n]", -1)) - F.when(F.col("t") == "", 1).otherwise(0)
    d = d.select("uri", F.sha2(F.encode("t", "ISO-8859-1"), 256).alias("content_hash"), F.when(~F.contains(F.col("t"), F.lit("\u0000")), lines).alias("n_lines"))
    return d.join(F.broadcast(where), "uri").drop("uri")


def locator_valid(locator, n_lines):
    """Whether a locator L3 or L3-L9 names lines that the file has; binary files have none."""
    at = r"^L([1-9][0-9]*)(?:-L?([1-9][0-9]*))?\z"
    first = F.regexp_extract(locator, at, 1).try_cast("bigint")
    last = F.coalesce(F.regexp_extract(locator, at, 2).try_cast("bigint"), first)
    return F.coalesce(locator.rlike(at) & (first <= last) & (last <= n_lines), F.lit(False))


def python_files(spark: SparkSession, root) -> DataFrame:
    """path (relative, with /), content (line ends made one), sha256: the Python files below root, without hidden, built and linked ones."""
    root = Path(root).expanduser().resolve()
    if not root.is_dir():
        raise BundleError(f"{root} is no folder")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(str(root))
    base = len(root.as_uri()) + 1
    d = d.select(F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:///'), {base + 1})").alias("path"),
                 F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1").alias("content"))
    parts = F.split("path", "/")
    d = d.filter(~F.exists(parts, lambda p: p.startswith(".") | p.isin(NO_SOURCE)))
    linked = [p.relative_to(root).as_posix() for p in root.rglob("*.py") if p.is_symlink() or not p.resolve().is_relative_to(root)]
    d = d.filter(~F.col("path").isin(linked)) if linked else d
    return d.withColumn("sha256", F.sha2("content", 256))


def folder_digest(root, without=NO_SNAPSHOT) -> str:
    """snapshot:SHA-256 over the sorted names and bytes of all files below root; one stream, as order counts."""
    root, h = Path(root).resolve(), hashlib.sha256()
    for p in sorted(root.rglob("*")):
        rel = p.relative_to(root)
        if p.is_symlink() or not p.is_file() or set(rel.parts) & set(without):
            continue
        h.update(rel.as_posix().encode() + b"\0")
        with open(p, "rb") as f:
            while chunk := f.read(1 << 20):
                h.update(chunk)
        h.update(b"\0")
    return f"snapshot:{h.hexdigest()}"
