"""Changed files that were not written by hand: generated, minified, vendored, recorded, or data kept as code.

Method: winnowing. The token stream of a patch (the new and the kept lines, without comments, in lower case) is hashed in runs of
RUN tokens, and the least hash of every WINDOW neighbours is kept as a fingerprint; a file is a vendored copy where at least
SHARE of its fingerprints recur in REPOSITORIES or more unrelated repositories. A text too short for LEAST_PRINTS has the hash of
all its tokens (SHORT at least) for a fingerprint. Recurrence alone can't tell files of a tool's making or a copy that stands in
one repository, so that the origin that a path or the text itself states is read beside it: marks of a generator or of foreign
authors in comments, minified or bundled lines, tables of data, recorded output.

Scale: fingerprints are counted in two steps (distinct repositories, then their number), so that the counts of a fingerprint
that stands in a third of all files are combined before the shuffle; only fingerprints of recurring kind return to the files,
by a join whose hot side is spread over SALTS.

Defined results: where the patch is null, empty or says nothing, the path decides; null paths have no evidence; a file_id
delivered again counts once; a removed file is judged by its deleted lines; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.runtime import broadcast_if_small, materialize, ship_package

RUN, WINDOW = 50, 16
SHARE, REPOSITORIES, LEAST_PRINTS = 0.8, 4, 8
#: A text of fewer prints, but of so many tokens, has one: the hash of all its tokens.
SHORT = 24
SALTS = 8

#: Names of lock files.
LOCKS = frozenset(
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock uv.lock pdm.lock cargo.lock packages.lock.json composer.lock"
    " gemfile.lock go.sum go.work.sum bun.lockb bun.lock flake.lock mix.lock pubspec.lock podfile.lock gradle.lockfile paket.lock".split()
)
#: Names that a tool gives its output.
NAME = re.compile(
    r"(?:[.-]min\.(?:js|mjs|cjs|css|html)|[.-](?:bundle|chunk)\.(?:js|mjs|cjs|css)|\.(?:js|mjs|cjs|css|ts)\.map|\.snap|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|swift|rb)|_pb\.(?:js|ts|rb)"
    r"|\.g\.(?:cs|dart|i\.cs)|\.designer\.(?:cs|vb)|[._-]generated\.\w+|\.gen\.\w+|\.freezed\.dart|\.pb\.validate\.go|_mock\.gen\.go|\.lock)$|^zz_generated",
    re.IGNORECASE,
)
#: Folders of outputs, and of third parties where a folder of the copied library follows.
OUTPUT = frozenset("node_modules bower_components jspm_packages __snapshots__ __generated__ site-packages dist .next .nuxt cassettes".split())
FOREIGN = frozenset("vendor vendored third_party third-party thirdparty 3rdparty external externals extern ext deps upstream".split())

COMMENT = r"(?:#|//|/\*+!?|\*|--|<!--|;|%|\"\"\"|''')"
#: What tools and foreign authors write into the heads of files.
MADE = re.compile(
    rf"^\s*{COMMENT}\s*.*(?i:@generated\b|\bcode generated by\b|<auto-?generated\b|\bauto-?generated (?:file|by|code|from)\b(?! for)|^\W*this (?:file|code|class) (?:was|is) (?:automatically|auto)[- ]?(?:created|generated|produced|built|written)"
    r"|\bmachine[- ](?:written|made|generated)\b|\bgenerated (?:file|code)\b.*\bdo not (?:edit|modify|change)|\bdo not (?:edit|modify) (?:this file|by hand|manually)\b|\b(?:produced|created|generated|written|emitted|rendered) by [\w.-]+\W.*\b(?:change|edit) the (?:template|source|schema|generator)"
    r"|\b(?:built|generated|compiled|created|rendered) from \S+ by \S+|\bchanges (?:will be|are) (?:overwritten|lost)\b|\bmanual changes are lost\b|\bregenerate with\b)"
)
COPIED = re.compile(
    rf"^\s*{COMMENT}\s*.*(?i:\bcopied (?:unchanged|verbatim|as[- ]is)? ?from upstream\b|\bcopied (?:unchanged|verbatim) from\b|\bvendored (?:from|copy)\b|\(c\) (?:\d{{4}} )?the \w+ (?:authors|contributors)\b.*\b(?:released|licensed)\b"
    r"|\bpermission to use\b.*\bgranted by its authors\b|\bpermission is hereby granted, free of charge\b)"
)
BUNDLE = re.compile(r"^\s*/\*{3,}/|__webpack_require__|\b__modules__\b|^\s*eval\(\"")
RECORDED = re.compile(r"^\s*// (?:Jest )?Snapshot v\d|^\s*exports\[`[^`]*\d+`\]\s*=|_pool\.AddSerializedFile\(|_serialized_start\s*=|^\s*\{\"version\":3,\"(?:sources|file)\"|^\s*\"?mappings\"?:")
LOCKED = re.compile(r"\"?(?:integrity|checksum|resolved)\"?\s*[:=]?\s*\"?(?:sha(?:1|256|384|512)-|https?://)")
NUMBERS = re.compile(r"^\s*[\[({]*\s*(?:[-+]?(?:0x[0-9a-f]+|\d[\d_]*(?:\.\d+)?(?:e[-+]?\d+)?)[fFlLuU]?\s*[,\s;]\s*){4,}[-+.\w]*[\s\])},;]*$", re.IGNORECASE)
BLOB = re.compile(r"^\s*(?:\w+\s*=\s*)?[bB]?[rR]?[\"'`]?[A-Za-z0-9+/\\x]{48,}={0,2}[\"'`]?\s*[+,;)\\]?\s*$")
ROWS = re.compile(r"^\s*(?:\w+\s*[:=].{0,30})?[\[{]?\s*(?:[\[({]\s*(?:[-\d.]+|['\"][^'\"]*['\"]|null|none|true|false)(?:\s*,\s*(?:[-\d.]+|['\"][^'\"]*['\"]|null|none|true|false))+\s*[\])}]\s*,?\s*){2,}", re.IGNORECASE)
INSERTS = re.compile(r"^\s*insert into [\w.\"`]+ (?:\([^)]*\) )?values\s*\(", re.IGNORECASE)
OPEN_LIST = re.compile(r"^\s*(?:export\s+)?(?:const\s+|static\s+|final\s+)*[A-Z_][A-Z0-9_]*(?::[^=]+)?\s*=\s*[\[({]\s*$|^\s*[\])}]+[;,]?\s*$")
#: A text in lower case that holds none of these has no mark; most texts end here.
MARKS = (
    "generated", "machine-", "machine ", "do not edit", "do not modify", "produced by", "created by", "written by", "emitted by", "rendered by", "built from", "compiled from", "created from", "rendered from",
    "created;", "overwritten", "changes are lost", "regenerate", "copied", "vendored", "(c)", "permission", "automatically", "auto-",
)
BUNDLES = ("/***", "__webpack", "__modules__", "eval(")
RECORDS = ("snapshot v", "exports[`", "_serialized", "addserializedfile", '"version":3', "mappings")
LOCK_WORDS = ("sha1-", "sha256-", "sha384-", "sha512-", "resolved", "integrity", "checksum")
HINTS = (*MARKS, *BUNDLES, *RECORDS, *LOCK_WORDS, "insert into")


def _worth(patch: str) -> bool:
    """Whether a text can hold evidence at all: a mark, a long line or word, or many digits."""
    low = patch.lower()
    if any(h in low for h in HINTS):
        return True
    if len(patch) >= 400 and 4 * sum(map(patch.count, "0123456789")) >= len(patch):
        return True
    return max(map(len, patch.split())) >= 48 or max(map(len, patch.split("\n"))) >= 200


CODE_NAME = re.compile(r"\.(?:js|mjs|cjs|jsx|css|ts|tsx|html|svg|json)$", re.IGNORECASE)


def path_evidence(path: str | None) -> str | None:
    """What a path says of a file's origin, or null."""
    if not path:
        return None
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts:
        return None
    name, folders = parts[-1].lower(), [p.lower() for p in parts[:-1]]
    if name in LOCKS:
        return "lock file"
    if NAME.search(name):
        return "generated name"
    if any(f in OUTPUT for f in folders):
        return "output folder"
    if any(f in FOREIGN for f in folders[:-1]):
        return "third-party folder"
    return None


def text_evidence(path: str | None, patch: str | None) -> str | None:
    """What a patch says of a file's origin, or null."""
    if not patch or not patch.strip() or not _worth(patch):
        return None
    lines, key = [], False
    for raw in re.split(r"\r?\n", patch or ""):
        if raw.startswith(("@@", "+++", "--- ", "\\ ", "diff ", "index ")):
            continue
        line = raw[1:] if raw[:1] in "+- " else raw
        if not line.strip():
            continue
        if "-----BEGIN " in line:
            key = "-----END " not in line
            continue
        if key:  # a key or certificate isn't the file's own text
            key = "-----END " not in line and re.fullmatch(r"\s*[A-Za-z0-9+/=]+\s*", line) is not None
            continue
        lines.append(line)
    if not lines:
        return None
    low = patch.lower()
    if any(h in low for h in MARKS):
        for line in lines:
            if line.lstrip()[:1] in "#/*-<;%\"'" and any(h in line.lower() for h in MARKS):
                if MADE.search(line):
                    return "generated mark"
                if COPIED.search(line):
                    return "copied mark"
    size = sum(map(len, lines))
    if len(lines) > 1 and any(h in low for h in BUNDLES) and sum(bool(BUNDLE.search(x)) for x in lines) * 3 >= len(lines):
        return "bundled"
    if any(h in low for h in RECORDS):
        recorded = sum(bool(RECORDED.search(x)) for x in lines)
        if recorded and (recorded >= 2 or recorded * 4 >= len(lines)):
            return "recorded output"
    if any(h in low for h in LOCK_WORDS):
        locked = sum(bool(LOCKED.search(x)) for x in lines)
        if locked >= 3 and locked * 4 >= len(lines):
            return "lock file"
    dense = 0
    if CODE_NAME.search(path or ""):
        for x in lines:
            if len(x) >= 200 and x.count(" ") * 12 <= len(x) and 100 * len(re.findall(r"[;{}()=,:]", x)) >= 12 * len(x) and x.count("|") * 20 <= len(x):
                dense += len(x)
        if dense * 2 >= size:
            return "minified"
    if size < 400:
        return None
    data = sum(len(x) for x in lines if len(x) >= 20 and (NUMBERS.match(x) or BLOB.match(x) or INSERTS.match(x) or ROWS.match(x)))
    rest = sum(len(x) for x in lines if OPEN_LIST.match(x))
    if data >= 400 and data * 4 >= 3 * (size - rest):
        return "data as code"
    return None


_words = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]")
_known: dict[str, int] = {}
_power = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_notes = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/", re.DOTALL)


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base from 1, and those of its inverse from 0, modulo 2 ** 64."""
    if len(_power[0]) < n:
        m = max(4096, 2 * n)
        with np.errstate(over="ignore"):
            _power[0] = np.cumprod(np.full(m, _BASE, np.uint64))
            _power[1] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
    return _power[0][:n], _power[1][:n]


def fingerprints(patch: str | None, run: int = RUN, window: int = WINDOW) -> np.ndarray:
    """The winnowed fingerprints of a patch's new and kept lines (of its old ones, where it has no others).

    Where there are fewer than LEAST_PRINTS, the one fingerprint is of the whole stream, so that short copies count if exact.
    """
    kept, old = [], []
    for raw in (patch or "").split("\n"):
        if raw[:1] in "+ " and not raw.startswith("+++"):
            kept.append(raw[1:])
        elif raw[:1] == "-" and not raw.startswith("---"):
            old.append(raw[1:])
    words = _words.findall(_notes.sub(" ", "\n".join(kept or old)).lower())
    n = len(words) - run + 1
    import xxhash

    whole = np.array([xxhash.xxh64_intdigest("\0".join(words))], np.uint64).view(np.int64) if len(words) >= SHORT else np.zeros(0, np.int64)
    if n < 1:
        return whole

    if len(_known) > 500_000:
        _known.clear()
    try:
        h = np.array([*map(_known.__getitem__, words)], np.uint64)
    except KeyError:
        h = np.array([_known.get(w) or _known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
        # the hash of a run is its polynomial, brought to the same power wherever the run stands
        runs = (total[run:] - total[:-run]) * inverse[:n]
        runs ^= runs >> np.uint64(31)
        runs *= np.uint64(0xBF58476D1CE4E5B9)
        runs ^= runs >> np.uint64(29)
    # the least of every window, by windows of doubling size
    least, size, window = runs, 1, min(window, n)
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    prints = np.unique(least).view(np.int64)
    return prints if len(prints) >= LEAST_PRINTS else whole


def evidence(files: DataFrame) -> DataFrame:
    """(file_id, repository, own, prints): each delivery of a file with what path and text say, and its fingerprints."""
    ship_package(files.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            ids, repos, paths, patches = (rb.column(k).to_pylist() for k in range(4))
            own = [text_evidence(a, b) or path_evidence(a) for a, b in zip(paths, patches)]
            prints = [fingerprints(b) for b in patches]
            edge = np.cumsum([0, *map(len, prints)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*prints, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array(own, pa.string()), lists], ["file_id", "repository", "own", "prints"])

    plain = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), "repository", "file_path", "patch")
    return plain.mapInArrow(run, "file_id long, repository string, own string, prints array<long>")


def recurring(table: DataFrame) -> DataFrame:
    """(print): the fingerprints of REPOSITORIES or more unrelated repositories.

    Forks bear one name under several owners, and an owner's repositories are related: both owners and names must be as many.
    They are counted for the fingerprints alone that recur at all.
    """
    pairs = table.select("repository", F.explode("prints").alias("print")).distinct()
    often = materialize(pairs.groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") >= REPOSITORIES).select("print"), "recurring")
    owner, name = F.substring_index("repository", "/", 1), F.substring_index("repository", "/", -1)
    both = table.select("repository", F.explode("prints").alias("print")).join(broadcast_if_small(often), "print").select("print", owner.alias("owner"), name.alias("name")).distinct()
    counts = both.groupBy("print").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("name").alias("names"))
    return counts.where(F.least("owners", "names") >= REPOSITORIES).select("print")


def unwritten(files: DataFrame) -> DataFrame:
    """(file_id, reason) of the files not written by hand. What a text or path says comes before recurrence."""
    table = materialize(evidence(files), "evidence")
    own = table.where("own is not null").groupBy("file_id").agg(F.min("own").alias("reason"))
    # a fingerprint may stand in a third of all files: both sides are spread by a salt of the file
    shared = recurring(table).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    unsaid = table.where(F.col("own").isNull() & (F.size("prints") > 0))
    prints = unsaid.select("file_id", F.size("prints").alias("n"), F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("prints").alias("print"))
    copies = (
        prints.join(shared, ["print", "salt"])
        .groupBy("file_id")
        .agg((F.countDistinct("print") / F.max("n")).alias("share"))
        .where(F.col("share") >= SHARE)
        .select("file_id", F.lit("recurring copy").alias("reason"))
    )
    return own.union(copies).groupBy("file_id").agg(F.min("reason").alias("reason"))


def found(files: DataFrame) -> DataFrame:
    return unwritten(files).select("file_id")


def skipped_by_reason(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(provider, repository, number, skipped_by_reason): each change-set of the diagnostics with its counts made anew.

    Deliveries of a file count once, by its first change-set in order of ingestion; the provider is taken in lower case.
    """
    key = [F.lower("provider").alias("provider"), "repository", "number"]
    where = files.groupBy("file_id").agg(F.min_by(F.struct(*key), F.struct("ingested_at", "provider", "repository", "number")).alias("k")).select("file_id", "k.*")
    counts = unwritten(files).join(where, "file_id").groupBy("provider", "repository", "number", "reason").agg(F.count("*").cast("int").alias("n"))
    maps = counts.groupBy("provider", "repository", "number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("m"))
    runs = diagnostics.select(*key).distinct()
    m = maps.select(*(F.col(k).alias(f"m_{k}") for k in ("provider", "repository", "number")), "m")
    on = F.expr("provider <=> m_provider and repository <=> m_repository and number <=> m_number")
    empty = F.create_map().cast("map<string,int>")
    return runs.join(m, on, "left").select("provider", "repository", "number", F.coalesce("m", empty).alias("skipped_by_reason"))
