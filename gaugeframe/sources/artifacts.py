"""Driver-side bookkeeping: manifests, configs, fingerprints, run folders and atomic files."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from gaugeframe.functions.canonical import canonical_hash, canonical_json

#: What a full revision looks like, and the sections and keys a manifest may use.
REVISION = re.compile(r"[0-9a-f]{40}")
SHA256 = re.compile(r"[0-9a-f]{64}")
SECTIONS = ("sources", "repositories", "datasets", "files")
KINDS = ("git", "http", "huggingface")


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def load_mapping(path: str | Path) -> dict:
    """A JSON mapping, or YAML where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


@dataclass(frozen=True)
class Artifact:
    name: str
    kind: str
    destination: str
    revision: str | None = None
    url: str | None = None
    repo_id: str | None = None
    sha256: str | None = None
    include: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = []
        if self.kind not in KINDS:
            out.append(f"{self.name}: unknown kind {self.kind!r}")
        if self.kind in ("git", "huggingface") and not REVISION.fullmatch(self.revision or ""):
            out.append(f"{self.name}: revision is not a full one")
        if self.kind == "http" and not SHA256.fullmatch(self.sha256 or ""):
            out.append(f"{self.name}: sha256 is missing")
        if self.kind == "huggingface" and not self.repo_id or self.kind in ("git", "http") and not (self.url or self.repo_id):
            out.append(f"{self.name}: no location")
        return out


def manifest(path: str | Path) -> list[Artifact]:
    """The artifacts of a manifest, given as a list, a mapping, or named sections. All problems of
    pinning, repeated names and shape are raised together."""
    raw = load_mapping(path)
    given = raw.get("artifacts")
    if isinstance(given, list):
        pairs = [(str(x.get("name", "")) if isinstance(x, dict) else "", x) for x in given]
    elif isinstance(given, dict):
        pairs = [(str(k), v) for k, v in given.items()]
    else:
        pairs = [(str(k), v) for s in SECTIONS if isinstance(raw.get(s), dict) for k, v in raw[s].items()]
    out, problems, seen = [], [], set()
    for name, entry in pairs:
        if not name or not isinstance(entry, dict):
            problems.append(f"{name or 'entry'}: no named mapping")
            continue
        if name in seen:
            problems.append(f"{name}: repeated")
        seen.add(name)
        first = lambda *keys, entry=entry: next((entry[k] for k in keys if entry.get(k)), None)
        include = first("include", "allow_patterns") or ()
        lower = lambda v: None if v is None else str(v).lower()
        known = {"name", "kind", "type", "destination", "path", "revision", "url", "repo_id", "sha256", "include", "allow_patterns"}
        out.append(Artifact(name, str(first("kind", "type") or ""), str(first("destination", "path") or f"data/external/{name}"), lower(entry.get("revision")), entry.get("url"), entry.get("repo_id"), lower(entry.get("sha256")), (include,) if isinstance(include, str) else tuple(map(str, include)), {k: v for k, v in entry.items() if k not in known}))
        problems += out[-1].problems()
    if not out:
        problems.append("no artifacts")
    if problems:
        raise ValueError("manifest: " + "; ".join(problems))
    return out


def validated_lock(path: str | Path) -> dict:
    """A lock whose sources and models are pinned and whose policy forbids pickles; every error is
    named in one exception."""
    lock = load_mapping(path)
    errors = [f"no mapping {s}" for s in ("sources", "models") if not isinstance(lock.get(s), dict)]
    for section in ("sources", "models"):
        for key, entry in (lock.get(section) or {}).items() if isinstance(lock.get(section), dict) else ():
            if not isinstance(entry, dict):
                errors.append(f"{section}.{key}: no mapping")
            elif not isinstance(entry.get("revision"), str) or not REVISION.fullmatch(entry["revision"]):
                errors.append(f"{section}.{key}: revision is not a full one")
    if (lock.get("policy") or {}).get("allow_pickle") is not False:
        errors.append("policy.allow_pickle is not false")
    if errors:
        raise ValueError("lock: " + "; ".join(errors))
    return lock


def config_mismatches(lock: dict, configs: dict[str, dict]) -> list[str]:
    """Full-outer comparison of a lock's models with config files (path to content)."""
    models, seen, out = lock["models"], set(), []
    for path, content in sorted(configs.items()):
        model = content.get("model") or {}
        key = model.get("key")
        if key not in models:
            out.append(f"{path}: unknown model {key!r}")
            continue
        seen.add(key)
        out += [f"{path}: {f} is {model.get(f)!r}, not {models[key].get(f)!r}" for f in ("repo_id", "revision") if model.get(f) != models[key].get(f)]
    return out + [f"no config for {k}" for k in sorted(set(models) - seen)]


def is_current(artifact: Artifact, root: str | Path) -> bool:
    """Whether what stands at the destination is the pinned artifact: by content for files, by a
    marker that names the revision for folders."""
    at = Path(root) / artifact.destination
    if at.is_file():
        return artifact.sha256 is not None and sha256_file(at) == artifact.sha256
    marker = at / ".revision"
    return marker.is_file() and artifact.revision is not None and marker.read_text(encoding="utf-8").strip() == artifact.revision


def fingerprint(root: str | Path, paths: list[str], extra: dict | None = None) -> dict:
    """Hashes of files and of all of them together, with further facts (such as a job's settings)."""
    files = {p: sha256_file(Path(root) / p) for p in sorted(paths)}
    body = {"files": files, "extra": extra or {}}
    return body | {"sha256": canonical_hash(body)}


def verify_fingerprint(recorded: dict, root: str | Path, what: str = "fingerprint") -> None:
    now = fingerprint(root, list(recorded["files"]), recorded["extra"])
    changed = sorted(p for p in now["files"] if now["files"][p] != recorded["files"][p])
    if changed or now["sha256"] != recorded["sha256"]:
        raise ValueError(f"{what} differs: {', '.join(changed) or 'hash'}")


def pending(jobs: list[dict], done: dict[str, str]) -> list[dict]:
    """Jobs whose signature is not that of a finished run (name to signature): resume by content."""
    return [j for j in jobs if done.get(j["name"]) != canonical_hash(j)]


def environment(spark=None) -> dict:
    """Versions and settings that a run depends on."""
    import pyspark

    out = {"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()}
    if spark is not None:
        out |= {"spark": spark.version, "settings": {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled")}}
    return out


def write_atomic(path: str | Path, data: bytes) -> None:
    """All or nothing: a temporary file in the same folder, synced, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value, indent: int | None = None) -> None:
    """Sorted keys and no NaN: canonical on one line, or indented."""
    text = canonical_json(value) if indent is None else json.dumps(value, sort_keys=True, indent=indent, ensure_ascii=False, allow_nan=False)
    write_atomic(path, (text + "\n").encode())


def run_folder(root: str | Path, name: str, settings: dict) -> Path:
    """A new folder named after a run and its settings' hash, with the settings in it; one that
    exists is refused."""
    at = Path(root) / f"{name}-{canonical_hash(settings)[:12]}"
    at.mkdir(parents=True, exist_ok=False)
    write_json(at / "settings.json", settings, 2)
    return at
