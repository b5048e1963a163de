"""The prepared table every detector reads.

One pass over the audited rows computes, per row: release id, dense row
number, three fingerprints (exact / split / feature), normalised label and
split, the token set's key, size and at-limit flag, the PII hits of every cell and
a hash of the raw row.  The pass is written once, with the token sets as sorted
text; only its narrow columns (hashes, short arrays) are sorted and numbered, and
every detector is an aggregate over them.  The token sets stay where the pass wrote
them (``Prepared.texts``) and are fetched by place for the rows that stand for a set.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ID_CANDIDATES, LABEL_CANDIDATES, MIN_NEAR_TOKENS, SPLIT_CANDIDATES, Limits, Release, Roles
from ..functions import pii as pii_fn
from ..functions import text as text_fn
from ..functions import tokens as tok_fn
from ..session import cut_lineage, stored
from .rows import file_order_key, release_copy, with_row_number

INTERNAL_PREFIX = "__"

#: Rows per partition for frames whose size has a proven bound.
ROWS_PER_PARTITION = 500_000

#: Bytes of a scan or of the written pass that make one task when rows are dealt out.
TASK_BYTES = 32 << 20

#: Bytes of the written pass that one sort task holds: in memory its narrow columns take several times as much.
SORT_BYTES = TASK_BYTES // 4


def infer_column(columns: list[str], requested: str | None, candidates) -> str | None:
    """Requested name (case-insensitive, no fallback when absent), else the
    first candidate present."""
    by_lower = {}
    for c in columns:
        by_lower.setdefault(c.lower(), c)
    req = (requested or "").strip()
    if req:
        return by_lower.get(req.lower())
    for cand in candidates:
        if cand in by_lower:
            return by_lower[cand]
    return None


def resolve_roles(columns: list[str], release: Release | None = None,
                  roles: Roles | None = None) -> Roles:
    if roles is not None:
        return roles
    rel = release or Release()
    return Roles(
        label=infer_column(columns, rel.label_column, LABEL_CANDIDATES),
        split=infer_column(columns, rel.split_column, SPLIT_CANDIDATES),
        id=infer_column(columns, rel.id_column, ID_CANDIDATES),
    )


def check_configured_columns(columns: list[str], release: Release) -> None:
    """A configured label/split/id column must exist (case-insensitive)."""
    lower = {c.lower() for c in columns}
    for what, req in (("label", release.label_column), ("split", release.split_column),
                      ("identifier", release.id_column)):
        if req and req.strip() and req.strip().lower() not in lower:
            raise ValueError(f"The configured {what} column does not exist in the dataset.")


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def resolve_release_roles(columns: list[str], releases: DataFrame) -> tuple[Roles, DataFrame | None]:
    """The roles of every release in a ``releases`` table.  A configured column
    that does not exist is refused by release id.  Releases that agree give one
    :class:`Roles`; otherwise the frame (release_id, label, split, id) says
    which column plays which role in each."""
    known = {}
    for c in columns:
        known.setdefault(c.lower(), c)
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None
    resolved, missing = {}, []
    for role, what, candidates in (("label", "label", LABEL_CANDIDATES), ("split", "split", SPLIT_CANDIDATES),
                                   ("id", "identifier", ID_CANDIDATES)):
        asked = F.lower(text_fn.js_trim(F.coalesce(F.col(f"{role}_column"), F.lit(""))))
        named = names[asked] if names is not None else F.lit(None).cast("string")
        default = infer_column(columns, None, candidates)
        resolved[role] = F.when(asked == "", F.lit(default).cast("string")).otherwise(named)
        missing.append(F.when((asked != "") & named.isNull(), F.lit(what)))
    frame = releases.select("release_id", *[c.alias(r) for r, c in resolved.items()],
                            F.coalesce(*missing).alias("__missing"))
    bad = frame.where(F.col("__missing").isNotNull()).agg(
        F.min("release_id").alias("r"), F.min_by("__missing", "release_id").alias("w")).first()
    if bad.r is not None:
        raise ValueError(f"Release {bad.r}: the configured {bad.w} column does not exist in the dataset.")
    frame = frame.drop("__missing")
    kinds = frame.select("label", "split", "id").distinct().limit(2).collect()
    if len(kinds) <= 1:
        return Roles(**kinds[0].asDict()) if kinds else resolve_roles(columns), None
    return Roles(), frame


def fingerprint(digests: dict[str, Column], keep: list[str], without=None) -> Column:
    """Row fingerprint over the kept columns: SHA-256 of the (sorted) column
    name -> value-digest JSON.  Equal exactly when all kept normalised
    values are equal; an empty column list gives one shared value.
    ``without(c)`` leaves a column out of some rows: NULL fields are not in
    the JSON, so such a row has the fingerprint of the table without it."""
    fields = [(F.when(~without(c), digests[c]) if without else digests[c]).alias(c) for c in sorted(keep)]
    body = F.to_json(F.struct(*fields)) if fields else F.lit("{}")
    return F.unhex(F.sha2(body, 256))


def scan_bytes(df: DataFrame) -> int:
    """Sum of the leaves' size estimates (file sizes for scans); no job runs."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    except Exception:
        return 0


def parallelism_floor(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer partitions than the session has
    cores (a small file with one row group) before the per-row text work, into pieces
    of at most ``TASK_BYTES``, so that a task's share does not grow with the table.
    Large inputs already arrive in thousands of splits and are left as they
    are, so the raw rows are never shuffled at scale."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    size = scan_bytes(df)
    try:
        split = int(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728").rstrip("b"))
    except ValueError:
        return df
    if size > 1 << 50 or size // max(split, 1) + 1 >= target:  # unknown, or enough
        return df
    return df.repartition(max(target, size // TASK_BYTES + 1))


@dataclass
class Prepared:
    """The prepared table and what was resolved to build it."""

    df: DataFrame
    roles: Roles
    columns: list[str]
    dtypes: dict[str, T.DataType]
    limits: Limits
    multi_release: bool
    n_releases: int = 1
    role_frame: DataFrame | None = None
    patterns: tuple[pii_fn.PiiPattern, ...] = pii_fn.PATTERNS
    #: (place, token_text): the token sets of the rows with at least ``MIN_NEAR_TOKENS``
    texts: DataFrame | None = None
    counts: dict = field(default_factory=dict)
    _memo: dict = field(default_factory=dict)

    def has_role(self, role: str) -> bool:
        """Whether any release has the role (label, split or id)."""
        return self.role_frame is not None or bool(getattr(self.roles, role))

    def with_role(self, df: DataFrame, role: str, name: str = "__role") -> DataFrame:
        """``df`` with the name of the column that plays the role in its release."""
        if self.role_frame is None:
            return df.withColumn(name, F.lit(getattr(self.roles, role)).cast("string"))
        return df.join(self.role_frame.select("release_id", F.col(role).alias(name)), "release_id", "left")

    def memo(self, name: str, build, max_rows: int | None = None, columns: bool = False):
        """Build a derived frame once per prepared table and keep it cached
        (checkpointed).  Names must carry every limit the frame depends on.
        ``max_rows`` is a proven bound on the frame's size: small frames are
        kept in proportionally few partitions.  Wide ones are kept by ``columns``."""
        if name not in self._memo:
            built = build()
            parts = None if max_rows is None else max(1, -(-max_rows // ROWS_PER_PARTITION))

            def keep(df):
                if columns:
                    return stored(df, name)
                # dealt out anew, never coalesced: the work below keeps its tasks
                return cut_lineage(df.repartition(parts) if parts else df)
            self._memo[name] = (tuple(keep(b) for b in built) if isinstance(built, tuple)
                                else keep(built))
        return self._memo[name]

    def with_limits(self, limits: Limits) -> "Prepared":
        """The same prepared rows under other limits, sharing derived frames
        (token limits must match: tokens are part of the prepared rows)."""
        if limits.token_limit != self.limits.token_limit:
            raise ValueError("a different token limit needs its own prepared table")
        return Prepared(df=self.df, roles=self.roles, columns=self.columns, dtypes=self.dtypes,
                        limits=limits, multi_release=self.multi_release,
                        n_releases=self.n_releases, role_frame=self.role_frame,
                        patterns=self.patterns, texts=self.texts, counts=self.counts, _memo=self._memo)


def prepare(df: DataFrame, *, release_id: str = "release", release_col: str | None = None,
            roles: Roles | None = None, release: Release | None = None,
            limits: Limits = Limits(), order_by: list[Column] | None = None,
            carry: tuple[str, ...] = (),
            releases: DataFrame | None = None,
            patterns: Sequence[pii_fn.PiiPattern] = pii_fn.PATTERNS, cells: bool = True) -> Prepared:
    """Build the prepared table of an audited DataFrame.

    ``release_col`` names a column that assigns rows to releases (many
    releases audited in one job); otherwise all rows form ``release_id``.
    ``order_by`` fixes the row order (row numbers in evidence); by default
    the order rows have in their source files.  ``carry`` columns ride
    along untouched (not audited) so the same prepared table can later be
    regrouped into other releases (see :func:`regroup`).  ``releases`` gives
    each release its own label, split and id columns (``roles`` overrides it).
    Without ``cells`` the table has no token sets and no identifiers, which only near
    duplicates and PII ask for and which take most of the pass; those fail on such a table.
    """
    columns = [c for c in df.columns
               if c != release_col and c not in carry and not c.startswith(INTERNAL_PREFIX)]
    carried = [F.col(f"`{c}`") for c in carry]
    if release is not None:
        check_configured_columns(columns, release)
    role_frame = None
    if roles is None and releases is not None:
        roles, role_frame = resolve_release_roles(columns, releases)
    roles = resolve_roles(columns, release, roles)
    dtypes = {f.name: f.dataType for f in df.schema.fields}

    order = list(order_by) if order_by is not None else []
    order = order + file_order_key(df)
    rid = (F.col(release_col).cast("string") if release_col else F.lit(release_id))

    # --- the order key is taken at the scan, before any redistribution
    keyed = df.select(
        rid.alias("release_id"),
        F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]).alias("__ord"),
        *carried, *[F.col(f"`{c}`") for c in columns])
    keyed = parallelism_floor(keyed)
    role_cols = []
    if role_frame is not None:
        role_cols = [f"__role_{r}" for r in ("label", "split", "id")]
        keyed = keyed.join(role_frame.select("release_id", *[F.col(c[7:]).alias(c) for c in role_cols]),
                           "release_id", "left")

    def plays(c: str, *names: str) -> Column:
        """Whether column ``c`` plays one of the roles in the row's release."""
        out = F.lit(False)
        for r in names:
            out = out | F.coalesce(F.col(f"__role_{r}") == c, F.lit(False))
        return out

    # --- pass 1: NFKC once per string column, everything else from it
    nfkc_cols = {c: f"__nfkc_{i}" for i, c in enumerate(columns)
                 if isinstance(dtypes[c], T.StringType)}
    base = keyed.select(
        "release_id", "__ord", *carried, *role_cols,
        *[F.col(f"`{c}`") for c in columns],
        *[text_fn.nfkc(F.col(f"`{c}`")).alias(n) for c, n in nfkc_cols.items()],
    )

    norm = {c: text_fn.normalized(F.col(f"`{c}`"), dtypes[c],
                                  F.col(nfkc_cols[c]) if c in nfkc_cols else None)
            for c in columns}
    digest_names = {c: f"__d_{i}" for i, c in enumerate(columns)}
    feature_excl = {r for r in (roles.id, roles.split, roles.label) if r}
    token_cells = [tok_fn.cell_tokens(F.col(nfkc_cols[c]), limits.token_limit)
                   for c in columns if c in nfkc_cols and c not in feature_excl]
    if role_frame is not None:
        token_cells = [F.when(~plays(c, "id", "split", "label"), t)
                       for c, t in zip([c for c in columns if c in nfkc_cols], token_cells)]
    tokens, at_limit = tok_fn.row_tokens(token_cells, limits.token_limit)

    split_norm = F.lit(None).cast("string")
    if roles.split:
        sn = norm[roles.split]
        split_norm = F.when(F.col(f"`{roles.split}`").isNull() | (sn == ""), F.lit(None)).otherwise(sn)
    label_norm = norm[roles.label] if roles.label else F.lit(None).cast("string")
    if role_frame is not None:
        split_norm = F.coalesce(*[F.when(plays(c, "split") & F.col(f"`{c}`").isNotNull() & (norm[c] != ""), norm[c])
                                  for c in columns])
        label_norm = F.coalesce(*[F.when(plays(c, "label"), norm[c]) for c in columns])

    id_text = F.lit(None).cast("string")
    if roles.id and (isinstance(dtypes[roles.id], T.StringType) or pii_fn.is_numeric(dtypes[roles.id])):
        id_text = text_fn.scalar_text(F.col(f"`{roles.id}`"), dtypes[roles.id])
    if role_frame is not None:
        texts = [F.when(plays(c, "id"), text_fn.scalar_text(F.col(f"`{c}`"), dtypes[c])) for c in columns
                 if isinstance(dtypes[c], T.StringType) or pii_fn.is_numeric(dtypes[c])]
        id_text = F.coalesce(*texts) if texts else id_text
    raw_json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]),
                         {"ignoreNullFields": "false"})
    stage = base.select(
        "release_id", "__ord", *carried, *role_cols,
        *[_digest(norm[c]).alias(digest_names[c]) for c in columns],
        label_norm.alias("label_norm"),
        split_norm.alias("split_norm"),
        tokens.alias("tokens"),
        at_limit.alias("at_limit"),
        pii_fn.cell_hits([(c, dtypes[c]) for c in columns], patterns).alias("pii_hits"),
        F.sha2(raw_json, 256).alias("row_hash"),
        id_text.alias("id_text"),
    )
    digests = {c: F.col(digest_names[c]) for c in columns}
    excl_exact = {roles.id} if roles.id else set()
    excl_split = {r for r in (roles.id, roles.split) if r}
    without = [(lambda c, r=r: plays(c, *r)) if role_frame is not None else None
               for r in (("id",), ("id", "split"), ("id", "split", "label"))]
    near = F.col("k") >= MIN_NEAR_TOKENS
    prepared = stage.select(
        "release_id", "__ord", *carried,
        fingerprint(digests, [c for c in columns if c not in excl_exact], without[0]).alias("fp_exact"),
        fingerprint(digests, [c for c in columns if c not in excl_split], without[1]).alias("fp_split"),
        fingerprint(digests, [c for c in columns if c not in feature_excl], without[2]).alias("fp_feature"),
        "label_norm", "split_norm", "row_hash", "id_text",
        *([F.array_join(F.sort_array("tokens"), " ").alias("__tokens"), F.size("tokens").alias("k"), "at_limit", "pii_hits"] if cells else []),
    )
    if cells:
        prepared = prepared.select("*", F.when(near, F.col("__tokens")).alias("token_text"),
                                   F.when(near, F.unhex(F.sha2("__tokens", 256))).alias("set_key"),
                                   F.monotonically_increasing_id().alias("place")).drop("__tokens")
    # one pass over the raw rows; everything after reads what it has written
    prepared = stored(prepared, "pass")
    texts = prepared.where(near).select("place", "token_text") if cells else None
    # known before the offsets (a row for each release and sort task) are joined
    n_releases = prepared.select("release_id").distinct().count() if release_col is not None else 1
    sorted_rows = with_row_number(prepared.drop("token_text"), [F.col("__ord")], group="release_id", max_groups=n_releases,
                                  partitions=scan_bytes(prepared) // SORT_BYTES)
    # the recovery point every detector starts from
    numbered = stored(sorted_rows.drop("__ord"), "rows")
    release_copy(sorted_rows)
    return Prepared(df=numbered, roles=roles, columns=columns, dtypes=dtypes,
                    limits=limits, multi_release=release_col is not None,
                    n_releases=n_releases, role_frame=role_frame, patterns=tuple(patterns), texts=texts)


def regroup(prep: Prepared, release_col: str) -> Prepared:
    """The same prepared rows split into the releases named by a carried
    column, renumbered inside each release in their previous order.  No
    pass over the raw rows: fingerprints, tokens and PII hits do not depend
    on the release, and every detector groups by ``release_id``."""
    df = (prep.df.withColumn("release_id", F.col(f"`{release_col}`").cast("string"))
          .withColumnRenamed("_row", "__prev"))
    n_releases = df.select("release_id").distinct().count()
    sorted_rows = with_row_number(df, [F.col("__prev")], group="release_id", max_groups=n_releases,
                                  partitions=scan_bytes(df) // SORT_BYTES)
    numbered = stored(sorted_rows.drop("__prev"), "rows")
    release_copy(sorted_rows)
    return Prepared(df=numbered, roles=prep.roles, columns=prep.columns, dtypes=prep.dtypes,
                    limits=prep.limits, multi_release=True, n_releases=n_releases, patterns=prep.patterns, texts=prep.texts)
