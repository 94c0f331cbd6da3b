"""Source trees of a git repository: listing and identity of a ref on the driver, blobs in tasks."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed in {repo}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def require_repository(repo: str) -> str:
    """The path, if it is one of a repository."""
    if not repo:
        raise ValueError("no path of a repository given")
    try:
        _git(repo, "rev-parse", "--git-dir")
    except (OSError, RuntimeError) as e:
        raise ValueError(f"not a git repository: {repo}") from e
    return repo


def resolve(repo: str, ref: str) -> dict[str, str]:
    """What a ref is: its own object and type, the commit it leads to, that commit's tree, date, author and subject."""
    require_repository(repo)
    facts = _git(repo, "log", "-1", "--format=%an%n%s", ref, "--").decode().split("\n")
    own = _git(repo, "rev-parse", "--verify", ref).decode().strip()
    return _commit(repo, ref) | {"object": own, "object_type": _git(repo, "cat-file", "-t", own).decode().strip(), "author": facts[0], "subject": facts[1]}


def _commit(repo: str, ref: str) -> dict[str, str]:
    commit, tree, date = _git(repo, "log", "-1", "--format=%H%n%T%n%cI", ref, "--").decode().split("\n")[:3]
    return {"ref": ref, "commit": commit, "tree": tree, "date": date}


def tree_rows(repo: str, ref: str) -> list[tuple[str, str, str, int | None, str]]:
    """(mode, type, oid, bytes, path), by path."""
    rows = []
    for line in _git(repo, "ls-tree", "-r", "-l", "-z", ref).decode().split("\0")[:-1]:
        head, path = line.split("\t", 1)
        mode, kind, oid, size = head.split()
        rows.append((mode, kind, oid, None if size == "-" else int(size), path))
    return sorted(rows, key=lambda r: r[4])


def read_tree(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    return spark.createDataFrame(tree_rows(repo, ref), "mode string, type string, oid string, bytes long, path string")


def read_blobs(repo: str, names: list[str]) -> dict[str, bytes | None]:
    """Contents by name (an oid or ref:path); None for those that are missing."""
    out, at, found = _git(repo, "cat-file", "--batch", data="".join(n + "\n" for n in names).encode()), 0, {}
    for name in names:
        end = out.index(b"\n", at)
        head = out[at:end].split(b" ")
        at = end + 1
        if head[-1] == b"missing":
            found[name] = None
            continue
        size = int(head[2])
        found[name] = out[at : at + size]
        at += size + 1
    return found


def read_sources(spark: SparkSession, repo: str, ref: str, suffixes: tuple[str, ...] = (".twee",), under: str = "game/", step: int = 500) -> DataFrame:
    """(file, text) of the tree's text files with these endings.  The driver lists names alone; blobs are read in tasks, some hundred a call, so the
    repository has to be on a folder that all executors share."""
    paths = [r[4] for r in tree_rows(repo, ref) if r[4].startswith(under) and r[4].lower().endswith(suffixes)]
    names = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, -(-len(paths) // step)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blobs = read_blobs(repo, [f"{ref}:{p}" for p in frame["file"]])
            yield pd.DataFrame({"file": frame["file"], "text": [(blobs[f"{ref}:{p}"] or b"").decode("utf-8", "replace") for p in frame["file"]]})

    return names.mapInPandas(read, "file string, text string")
