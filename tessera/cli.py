"""index, search and eval on the command line. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import os
import re
import sys
import unicodedata
from dataclasses import dataclass

from tessera import model as m
from tessera.operators import goldset as g
from tessera.operators.search import lexical_search
from tessera.plans import build, evaluation, retrieve
from tessera.plans.snapshot import Snapshots
from tessera.plans.store import Store
from tessera.session import local_session
from tessera.sources.embedding import HashEmbedder, HttpEmbedder, ProviderConfig

WARNING = "warning: source text is sent to an external embedding provider"
#: Environment names of the flags; a flag wins, then the environment, then the default.
ENVIRONMENT = {
    "semantic": "TESSERA_SEMANTIC", "base_url": "TESSERA_EMBEDDING_BASE_URL", "model": "TESSERA_EMBEDDING_MODEL", "dimensions": "TESSERA_EMBEDDING_DIMENSIONS",
    "backend": "TESSERA_INDEX_BACKEND", "api_key": "TESSERA_EMBEDDING_API_KEY",
}


@dataclass(frozen=True)
class Semantic:
    mode: str
    backend: str
    embedder: object = None
    external: bool = False


def safe(text: str) -> str:
    """Without characters that steer a terminal."""
    def shown(c: str) -> str:
        if c == "\n" or c == "\t" or unicodedata.category(c) not in ("Cc", "Cf"):
            return c
        n = ord(c)
        return f"\\x{n:02x}" if n < 256 else f"\\u{n:04x}" if n < 65536 else f"\\U{n:08x}"

    return "".join(map(shown, text))


def rendered(hits) -> str:
    """A head and the text of each hit."""
    blocks = []
    for h in hits:
        name = f" {h['symbol_name']}" if h["symbol_name"] else ""
        blocks.append(safe(f"{h['score']:.3f} {h['path']}:{h['start_line']}-{h['end_line']}{name}") + "\n" + safe(h["text"]) + "\n")
    return "".join(blocks) or "no results\n"


def _natural(text: str) -> int:
    if not re.fullmatch("[0-9]+", text) or not int(text):
        raise argparse.ArgumentTypeError("a whole number above 0")
    return int(text)


def semantic_settings(args, search: bool) -> Semantic:
    """The matrix of modes and backends."""
    pick = lambda name, default="": getattr(args, name, None) or os.environ.get(ENVIRONMENT[name]) or default
    mode = pick("semantic", "off")
    backend = pick("backend", "snapshot" if mode == "off" else "store")
    if mode not in build.MODES or backend not in ("snapshot", "store", "auto") or (backend == "auto" and not search) or (mode != "off" and backend == "snapshot"):
        raise m.InvalidConfig("invalid mode or backend")
    if mode == "off":
        return Semantic(mode, backend)
    url = pick("base_url")
    if not url:
        raise m.InvalidConfig("a provider url is needed")
    if url == "hash:":
        return Semantic(mode, backend, HashEmbedder())
    dimensions = str(pick("dimensions", "0"))
    if not re.fullmatch("[0-9]+", dimensions):
        raise m.InvalidConfig("invalid dimensions")
    config = ProviderConfig(url, pick("model"), int(dimensions), os.environ.get(ENVIRONMENT["api_key"], ""))
    return Semantic(mode, backend, HttpEmbedder(config), not config.local)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--version", action="version", version="tessera 1")
    verbs = top.add_subparsers(dest="verb", required=True)
    default = os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "tessera")
    for name in ("index", "search"):
        p = verbs.add_parser(name)
        p.add_argument("--store", default=default)
        p.add_argument("--semantic", choices=build.MODES)
        p.add_argument("--embedding-base-url", dest="base_url")
        p.add_argument("--embedding-model", dest="model")
        p.add_argument("--embedding-dimensions", dest="dimensions")
        p.add_argument("--index-backend", dest="backend", choices=("snapshot", "store", "auto"))
        if name == "search":
            p.add_argument("--limit", type=_natural, default=10)
            p.add_argument("--path-prefix", action="append", default=[])
            p.add_argument("--language", action="append", default=[])
        p.add_argument("repository")
        if name == "search":
            p.add_argument("query", nargs="+")
    p = verbs.add_parser("eval").add_subparsers(dest="what", required=True).add_parser("inventory")
    for flag in ("root", "checklist", "output", "repository"):
        p.add_argument(f"--{flag}", required=True)
    p.add_argument("--gold-set")
    return top


def index(spark, args) -> str:
    settings = semantic_settings(args, False)
    repository = build.repository_id_of(args.repository)
    corpus = build.ingest(spark, repository)
    snapshots = Snapshots(spark, os.path.join(args.store, "snapshots"), make=True)
    if settings.backend == "snapshot":
        n, _ = build.check_cost(corpus.chunks)
        snapshots.replace(repository, corpus.chunks, corpus.policy)
        return f"status=indexed chunks={n}\n"
    if settings.external:
        print(WARNING, file=sys.stderr)
    store = Store.create(spark, os.path.join(args.store, "store"))
    done = build.build(store, repository, corpus, settings.mode, settings.embedder)
    revision = snapshots.replace(repository, corpus.chunks, corpus.policy)
    snapshots.mark(repository, corpus.policy, revision, done.manifest.generation_id)
    return f"status={done.status} vectors={done.vectors} requests={done.requests} tokens={done.usage_tokens}\n"


def search(spark, args) -> str:
    settings = semantic_settings(args, True)
    repository = build.repository_id_of(args.repository)
    query = m.Query(repository, " ".join(args.query).strip(), args.limit, m.Filter(tuple(args.path_prefix), tuple(args.language)))
    by_snapshot = lambda: lexical_search(Snapshots(spark, os.path.join(args.store, "snapshots")).load(repository)[0], query.text, query.limit, query.filter, m.LANGUAGES, repository)
    if settings.backend == "snapshot":
        if args.backend != "snapshot":
            return rendered(by_snapshot().collect())
        with Store.open(spark, os.path.join(args.store, "store")).bind(repository) as reader:  # asked for by name: a rollback of the store
            chunks = Snapshots(spark, os.path.join(args.store, "snapshots")).rollback(repository, reader.manifest)
            return rendered(lexical_search(chunks, query.text, query.limit, query.filter, m.LANGUAGES, repository).collect())
    try:
        reader = Store.open(spark, os.path.join(args.store, "store")).bind(repository)
    except m.NotFound:
        if (settings.backend == "auto" and settings.mode != "required") or (settings.backend == "store" and settings.mode == "preferred"):
            return rendered(by_snapshot().collect())
        raise
    with reader:
        if settings.external:
            print(WARNING, file=sys.stderr)
        return rendered(retrieve.retrieve(reader, query, settings.mode, settings.embedder).hits.collect())


def _bounded(path: str, most: int, root: str) -> bytes:
    if not os.path.isabs(path) or os.path.normpath(path) != path or os.path.realpath(path).startswith(os.path.realpath(root) + os.sep):
        raise m.EvaluationError("location")
    with open(path, "rb") as f:
        return f.read(most + 1)


def inventory(spark, args) -> str:
    if not os.path.isabs(args.root) or not os.path.isdir(args.root):
        raise m.EvaluationError("root")
    checklist = g.parse_checklist(_bounded(args.checklist, 64 << 10, args.root))
    gold = g.parse_gold_set(_bounded(args.gold_set, g.MAX_GOLD_BYTES, args.root), args.repository) if args.gold_set else None
    report = evaluation.evaluate_tree(spark, args.root, args.repository, checklist, gold)
    evaluation.publish_report(args.output, evaluation.marshal(report, min(evaluation.MAX_REPORT_BYTES, max(1, checklist.budgets["max_output_bytes"]))), args.root)
    return f"decision={report['decision']}\n"


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    try:
        run = {"index": index, "search": search, "eval": inventory}[args.verb]
        sys.stdout.write(run(spark or local_session(), args))
        return 0
    except (m.InvalidConfig, m.InvalidQuery) as e:
        print(f"{args.verb}: {e}", file=sys.stderr)
        return 2
    except (m.EngineError, OSError) as e:
        print(f"{args.verb}: {e if isinstance(e, m.EngineError) else 'file error'}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
