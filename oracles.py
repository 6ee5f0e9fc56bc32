"""The registered queries in DuckDB SQL, written from their definitions.

Clustering is unrolled: one common table expression per seeding pick or Lloyd
round, over groups of points (a run, a part, or all of them).
"""

from __future__ import annotations

TRIAL_KS = [2, 4]
TRIAL_ROUNDS = [0, 2]
TRIALS = 2
SWEEP_KS = [2, 3, 4]

REVIEWS = "SELECT l_partkey AS product, l_suppkey AS \"user\", l_quantity AS rating FROM lineitem"
def _normalized(reviews: str) -> str:
    return f"""
    SELECT product, "user", rating, rating - avg(rating) OVER (PARTITION BY "user") AS norm
    FROM ({reviews})"""


NORMALIZED = _normalized(REVIEWS)
MAX_NORM = f"SELECT product, max(norm) AS max_norm FROM ({NORMALIZED}) GROUP BY product"

OCCURRENCES = r"""
    SELECT doc_id, unnest(string_split(rtrim(text, ' '), ' ')) AS word
    FROM documents WHERE regexp_matches(text, '[^\x00-\x20]')"""
COUNTS = f"SELECT word, count(*) AS n FROM ({OCCURRENCES}) GROUP BY word"
# Length in UTF-16 units: characters above U+FFFF count twice.
LENGTH = r"(length(word) + length(regexp_replace(word, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"

SIZES = "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label"
LABELLED = f"""
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label AS cluster, size
    FROM embeddings JOIN ({SIZES}) s ON s.cluster = label"""
POINTS = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
POINTS_3D = f"SELECT id, x[1:3] AS x FROM ({POINTS})"


WORD = "18446744073709551616::UHUGEINT"
INCREMENT = 0x9E3779B97F4A7C15


def _uniform(seed: object, turn: object, row_id: str) -> str:
    digits = f"substr(md5(concat_ws(':', {seed}, {turn}, {row_id})), 1, 13)"
    return f"(('0x' || {digits})::BIGINT / 4503599627370496.0::DOUBLE)"


def _mixed(state: str, steps: str) -> str:
    """The splitmix64 generator's output some increments after a state, by 128-bit arithmetic."""

    def times(z: str, factor: int) -> str:
        return f"CAST({z}::UHUGEINT * {factor}::UHUGEINT % {WORD} AS UBIGINT)"

    start = (
        f"CAST(({state}::UHUGEINT + {steps}::UHUGEINT * {INCREMENT}::UHUGEINT % {WORD}) % {WORD}"
        " AS UBIGINT)"
    )
    one = f"list_transform([{start}], lambda z: {times('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)})"
    two = f"list_transform({one}, lambda z: {times('xor(z, z >> 27)', 0x94D049BB133111EB)})"
    return f"list_transform({two}, lambda z: xor(z, z >> 31))[1]"


def _arrival(seed: str, turn: int, row_id: str) -> str:
    state = f"('0x' || substr(md5({row_id}::VARCHAR), 1, 15))::UBIGINT"
    draw = _mixed(_mixed(state, seed), str(turn + 1))
    return f"-ln((({draw} >> 12)::DOUBLE + 1) / 4503599627370496.0::DOUBLE)"


def _merged(keys: int) -> str:
    return rf"""
    WITH joined AS (
        SELECT string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY doc_id % {keys}
    ), trimmed AS (
        SELECT regexp_replace(regexp_replace(text, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS text
        FROM joined
    ), occurrences AS (
        SELECT unnest(string_split(text, ' ')) AS word FROM trimmed WHERE text <> ''
    )
    SELECT word, count(*) AS n FROM occurrences GROUP BY word"""


def _sample(t: float, seed: int) -> str:
    return f"""
    SELECT * FROM ({LABELLED})
    WHERE {_uniform(seed, 0, 'id')} <= least({t} / size, 1)"""


def _scores(points: str, sample: str, divisor: str) -> str:
    """Per point a, b and score, from all pairs of points and sampled points."""
    return f"""
    WITH p AS MATERIALIZED ({points}), s AS MATERIALIZED ({sample}), sums AS (
        SELECT p.id, p.cluster, s.cluster AS other,
               sum(list_distance(p.x, s.x) ** 2) / {divisor} AS average
        FROM p, s GROUP BY p.id, p.cluster, s.cluster
    ), ab AS (
        SELECT id, cluster, max(average) FILTER (other = cluster) AS a,
               min(average) FILTER (other <> cluster) AS b
        FROM sums GROUP BY id, cluster
    )
    SELECT id, cluster, a, b,
           CASE WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0
                THEN (b - a) / greatest(a, b) END AS score
    FROM ab"""


def _mean_score(scores: str) -> str:
    return f"""
    SELECT round(avg(score), 9) AS silhouette, count(score) AS points FROM ({scores})"""


def _nearest(points: str, centers: str, out: str) -> str:
    """Each point of a group with the nearest of its group's centers."""
    return f"""
    {out} AS MATERIALIZED (
        SELECT * FROM (
            SELECT p.grp, p.id, p.x, p.w, c.cid, list_distance(p.x, c.x) AS d,
                   row_number() OVER (
                       PARTITION BY p.grp, p.id ORDER BY list_distance(p.x, c.x), c.cid) AS nth
            FROM {points} p JOIN {centers} c ON c.grp = p.grp
        ) WHERE nth = 1
    )"""


def _seeding(base: str, name: str, k: int, gap: str = "d") -> list[str]:
    """Picks of every group of ``base`` (grp, id, x, w, k, seed) as ``name`` (grp, cid, id, x).

    Chances are weights times ``gap``, an expression of the distance ``d``.
    """
    ctes = []
    for turn in range(k):
        source = base if turn == 0 else f"{name}_d{turn - 1}"
        arrival = _arrival("seed", turn, "id") + ("" if turn == 0 else f" / (w * {gap})")
        chance = "" if turn == 0 else "AND w * d > 0"
        ctes.append(f"""
    {name}_p{turn} AS MATERIALIZED (
        SELECT grp, {turn} AS cid, id, x FROM (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {arrival}, id) AS nth
            FROM {source} WHERE k > {turn} {chance}
        ) WHERE nth = 1
    )""")
        known = "list_distance(b.x, c.x)"
        if turn > 0:
            known = f"CASE WHEN c.x IS NULL THEN b.d ELSE least(b.d, {known}) END"
        columns = "b.*" if turn == 0 else "b.* EXCLUDE (d)"
        ctes.append(f"""
    {name}_d{turn} AS MATERIALIZED (
        SELECT {columns}, {known} AS d
        FROM {source} b LEFT JOIN {name}_p{turn} c ON c.grp = b.grp
    )""")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_p{turn}" for turn in range(k))
    return [*ctes, f"{name} AS MATERIALIZED ({union})"]


def _means(near: str, out: str) -> str:
    """Weighted mean of each center's points."""
    return f"""
    {out} AS MATERIALIZED (
        SELECT grp, cid, list(mean ORDER BY axis) AS x FROM (
            SELECT grp, cid, axis, sum(w * x[axis]) / sum(w) AS mean
            FROM {near}, unnest(range(1, len(x) + 1)) AS dims(axis)
            GROUP BY grp, cid, axis
        ) GROUP BY grp, cid
    )"""


def _lloyd(base: str, start: str, name: str, rounds: int) -> list[str]:
    """``start`` (grp, cid, x) refined over ``base`` (grp, id, x, w, rounds) as ``name``."""
    ctes = [
        f"{name}_c0 AS MATERIALIZED (SELECT grp, cid, x FROM {start})",
        f"""{name}_t0 AS MATERIALIZED (
        SELECT grp, 'Infinity'::DOUBLE AS theta, min(rounds) AS rounds, false AS stopped
        FROM {base} GROUP BY grp)""",
    ]
    for turn in range(rounds):
        old, new = f"{name}_c{turn}", f"{name}_n{turn}"
        ctes.append(_nearest(base, old, f"{name}_a{turn}"))
        ctes.append(_means(f"{name}_a{turn}", f"{name}_m{turn}"))
        ctes.append(f"""
    {new} AS MATERIALIZED (
        SELECT c.grp, c.cid, coalesce(m.x, c.x) AS x
        FROM {old} c LEFT JOIN {name}_m{turn} m ON m.grp = c.grp AND m.cid = c.cid
    )""")
        ctes.append(f"""
    {name}_t{turn + 1} AS MATERIALIZED (
        SELECT t.grp, least(theta, cost) AS theta, rounds,
               stopped OR rounds <= {turn} OR NOT (cost < theta) AS stopped
        FROM {name}_t{turn} t JOIN (
            SELECT a.grp, sum(a.w * list_distance(a.x, n.x)) AS cost
            FROM {name}_a{turn} a JOIN {new} n ON n.grp = a.grp AND n.cid = a.cid GROUP BY a.grp
        ) c ON c.grp = t.grp
    )""")
        ctes.append(f"""
    {name}_c{turn + 1} AS MATERIALIZED (
        SELECT o.grp, o.cid, CASE WHEN t.stopped THEN o.x ELSE n.x END AS x
        FROM {old} o JOIN {new} n ON n.grp = o.grp AND n.cid = o.cid
        JOIN {name}_t{turn + 1} t ON t.grp = o.grp
    )""")
    return [*ctes, f"{name} AS MATERIALIZED (SELECT * FROM {name}_c{rounds})"]


def _moved(base: str, start: str, name: str, rounds: int) -> list[str]:
    """``start`` after ``rounds`` moves to the means, as ``name``."""
    ctes = [f"{name}_c0 AS MATERIALIZED (SELECT grp, cid, x FROM {start})"]
    for turn in range(rounds):
        old = f"{name}_c{turn}"
        ctes.append(_nearest(base, old, f"{name}_a{turn}"))
        ctes.append(_means(f"{name}_a{turn}", f"{name}_m{turn}"))
        ctes.append(f"""
    {name}_c{turn + 1} AS MATERIALIZED (
        SELECT c.grp, c.cid, coalesce(m.x, c.x) AS x
        FROM {old} c LEFT JOIN {name}_m{turn} m ON m.grp = c.grp AND m.cid = c.cid
    )""")
    return [*ctes, f"{name} AS MATERIALIZED (SELECT * FROM {name}_c{rounds})"]


def _query(ctes: list[str], final: str) -> str:
    return "WITH " + ",".join(ctes) + final


def _base(
    k: int, rounds: int, seed: int, w: str = "1.0::DOUBLE", grp: str = "0", points: str = POINTS
) -> str:
    return f"""base AS MATERIALIZED (
        SELECT {grp} AS grp, id, x, {w} AS w, {k} AS k, {rounds} AS rounds, {seed} AS seed
        FROM ({points}))"""


def _kmeans_sweep(ks: list[int], rounds: int, sample: float, seed: int) -> str:
    runs = ", ".join(f"({k}, {k}, {rounds}, {seed})" for k in ks)
    scores = []
    for k in ks:
        points = f"""SELECT id, x, cid AS cluster, count(*) OVER (PARTITION BY cid) AS size
        FROM near WHERE grp = {k}"""
        drawn = f"SELECT * FROM ({points}) WHERE {_uniform(seed, 0, 'id')} <= least({sample / k} / size, 1)"
        scored = _scores(points, drawn, f"least({sample / k}, max(s.size))")
        scores.append(f"""
    SELECT {k}::INTEGER AS k,
           CAST((SELECT count(*) FROM final WHERE grp = {k}) AS INTEGER) AS centers, silhouette
    FROM ({_mean_score(scored)})""")
    ctes = [
        f"runs(grp, k, rounds, seed) AS (VALUES {runs})",
        f"""base AS MATERIALIZED (
        SELECT grp, id, x, 1.0::DOUBLE AS w, k, rounds, seed FROM ({POINTS}), runs)""",
        *_seeding("base", "picks", max(ks), "(d * d)"),
        *_moved("base", "picks", "final", rounds),
        _nearest("base", "final", "near"),
    ]
    return _query(ctes, " UNION ALL ".join(scores))


def _first_centers(k: int, points: str = POINTS) -> str:
    return f"""first AS MATERIALIZED (
        SELECT 0 AS grp, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cid, x
        FROM ({points}) ORDER BY id LIMIT {k})"""


AXES = """
    SELECT cid, CAST(axis - 1 AS INTEGER) AS axis, round(x[axis], 9) AS coordinate
    FROM {}, unnest(range(1, len(x) + 1)) AS dims(axis)"""
WEIGHT = "(id % 5 + 1)::DOUBLE"


def _nearest_to_first(k: int, rounds: int, seed: int, final: str, points: str = POINTS) -> str:
    near = _nearest("base", "first", "near")
    return _query([_base(k, rounds, seed, points=points), _first_centers(k, points), near], final)


def _coreset(k: int, parts: int, rounds: int, seed: int) -> list[str]:
    part = f"CAST(floor({_uniform(seed, chr(39) + 'part' + chr(39), 'id')} * {parts}) AS INTEGER)"
    return [
        _base(k, rounds, seed, grp=part),
        *_seeding("base", "picks", k),
        *_lloyd("base", "picks", "local", rounds),
        _nearest("base", "local", "near"),
        """core AS MATERIALIZED (
        SELECT c.grp || ':0:' || c.cid AS id, c.x, count(n.id)::DOUBLE AS w
        FROM local c LEFT JOIN near n ON n.grp = c.grp AND n.cid = c.cid
        GROUP BY c.grp, c.cid, c.x)""",
    ]


def _kmedian_coreset(k: int, parts: int, rounds: int, seed: int) -> str:
    ctes = [
        *_coreset(k, parts, rounds, seed),
        f"""weighted AS MATERIALIZED (
        SELECT 0 AS grp, id, x, w, {k} AS k, {rounds} AS rounds, {seed} AS seed FROM core)""",
        *_seeding("weighted", "chosen", k),
        *_lloyd("weighted", "chosen", "final", rounds),
        f"everything AS MATERIALIZED (SELECT 0 AS grp, id, x, 1.0 AS w FROM ({POINTS}))",
        _nearest("everything", "final", "reached"),
    ]
    return _query(
        ctes,
        """
    SELECT (SELECT count(*) FROM core) AS coreset_points,
           CAST((SELECT count(*) FROM final) AS INTEGER) AS centers,
           round(avg(d), 9) AS objective
    FROM reached""",
    )


def _trials(seed: int) -> str:
    runs = [(k, r) for k in TRIAL_KS for r in TRIAL_ROUNDS for _ in range(TRIALS)]
    rows = ", ".join(f"({i}, {k}, {r}, {seed + i})" for i, (k, r) in enumerate(runs))
    ctes = [
        f"runs(grp, k, rounds, seed) AS (VALUES {rows})",
        f"""base AS MATERIALIZED (
        SELECT grp, id, x, 1.0::DOUBLE AS w, k, rounds, seed FROM ({POINTS}), runs)""",
        *_seeding("base", "picks", max(TRIAL_KS)),
        *_lloyd("base", "picks", "final", max(TRIAL_ROUNDS)),
        _nearest("base", "final", "near"),
    ]
    return _query(
        ctes,
        """
    SELECT k, rounds, count(*) AS trials, round(min(objective), 9) AS lowest,
           round(max(objective), 9) AS highest, round(avg(objective), 9) AS average
    FROM (SELECT grp, avg(d) AS objective FROM near GROUP BY grp) JOIN runs USING (grp)
    GROUP BY k, rounds""",
    )


def statements(
    top: int, k: int, sample: int, parts: int, rounds: int, keys: int, seed: int
) -> dict[str, str]:
    sampled = _sample(sample, seed)
    of_sample = f"least({float(sample)}, max(s.size))"
    top_rows = f"""
    SELECT product, round(max_norm, 9) AS max_norm FROM ({MAX_NORM})
    ORDER BY max_norm DESC, product LIMIT {top}"""
    parsed = """
    SELECT {}CAST(len(embedding) AS INTEGER) AS d, embedding[1]::DOUBLE AS first,
           CAST(axis - 1 AS INTEGER) AS axis, embedding[axis]::DOUBLE AS coordinate
    FROM embeddings, unnest(range(1, len(embedding) + 1)) AS dims(axis)"""
    reviews = """
    SELECT CAST(l_partkey AS VARCHAR) AS product, CAST(l_suppkey AS VARCHAR) AS "user",
           l_quantity AS rating, l_orderkey AS ts
    FROM lineitem"""
    return {
        "top_normalized": top_rows,
        "report_lines": rf"""
    SELECT product, product || ': best normalized rating ' ||
           regexp_replace(printf('%.7f', max_norm), '(\.\d+?)0+$', '\1') AS line
    FROM ({top_rows})""",
        "max_norm_rating": f"SELECT product, round(max_norm, 9) AS max_norm FROM ({MAX_NORM})",
        "normalized_ratings": f"""
    SELECT product, "user", rating, round(norm, 9) AS norm FROM ({NORMALIZED})""",
        "normalized_ratings_light": f"""
    SELECT product, "user", rating, round(norm, 9) AS norm
    FROM ({_normalized('SELECT l_partkey AS product, l_orderkey AS "user", l_quantity AS rating FROM lineitem')})""",
        "word_count": COUNTS,
        "word_count_salted": COUNTS,
        "word_count_partitioned": COUNTS,
        "word_count_partition_salted": COUNTS,
        "word_count_merged": _merged(keys),
        "distinct_words": f"""
    SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT word) AS distinct_words
    FROM ({OCCURRENCES})""",
        "word_length_int": f"""
    SELECT CAST(sum({LENGTH}) // count(*) AS BIGINT) AS avg_length FROM ({COUNTS})""",
        "word_length_stats": f"""
    SELECT round(sum({LENGTH} * n) / sum(n), 9) AS avg_all, round(avg({LENGTH}), 9) AS avg_distinct
    FROM ({COUNTS})""",
        "doc_term_counts": f"""
    SELECT doc_id, word, count(*) AS n FROM ({OCCURRENCES}) GROUP BY doc_id, word""",
        "sum_of_squares": "SELECT round(sum(value * value), 3) AS sum_of_squares FROM events",
        "max_value": """
    SELECT max(value) AS by_value, arg_max(value, value) AS by_order FROM events""",
        "validated_numbers": """
    SELECT value FROM events WHERE isfinite(value) AND value >= 0""",
        "scaled_numbers": """
    SELECT value, round(value / nullif(max(value) OVER (), 0), 9) AS share FROM events""",
        "normalized_histogram": """
    WITH shares AS (
        SELECT value / nullif(max(value) OVER (), 0) AS share, count(*) OVER () AS total FROM events
    ), counts AS (
        SELECT CASE WHEN coalesce(share, 0) = 0 THEN 0.1::DOUBLE
                    ELSE ceil(share * 10) / 10 END AS hi,
               count(*) AS n, max(total) AS total
        FROM shares GROUP BY 1
    )
    SELECT hi, n,
           CASE WHEN hi = 0.1::DOUBLE THEN '[0' ELSE '(' || printf('%.1f', hi - 0.1) END
           || ',' || printf('%.1f', hi) || ']' AS label
    FROM counts WHERE n >= total // 10 ORDER BY hi""",
        "parsed_reviews": reviews,
        "file_reviews": reviews,
        "file_points": parsed.format(""),
        "file_labelled_points": parsed.format("label AS cluster, "),
        "file_top_products": f"""
    SELECT CAST(product AS VARCHAR) AS product, round(max_norm, 9) AS max_norm
    FROM ({MAX_NORM}) ORDER BY max_norm DESC, 1 LIMIT {top}""",
        "parsed_numbers": """
    SELECT value FROM events UNION ALL SELECT CAST(event_id AS DOUBLE) AS value FROM events""",
        "parsed_points": parsed.format(""),
        "parsed_labelled_points": parsed.format("label AS cluster, "),
        "cluster_sizes": SIZES,
        "points_with_sizes": f"SELECT id, cluster, size FROM ({LABELLED})",
        "cluster_sample": f"SELECT id, cluster, size FROM ({sampled})",
        "silhouette_approx": _mean_score(_scores(LABELLED, sampled, of_sample)),
        "silhouette_full": _mean_score(_scores(LABELLED, LABELLED, "count(*)")),
        "silhouette_sample": _mean_score(_scores(sampled, sampled, "count(*)")),
        "silhouette_points": f"""
    SELECT id, cluster, round(a, 9) AS a, round(b, 9) AS b, round(score, 9) AS score
    FROM ({_scores(LABELLED, sampled, of_sample)})""",
        "nearest_center": _nearest_to_first(
            k, rounds, seed, "\n    SELECT id, cid, round(d, 9) AS d FROM near"
        ),
        "nearest_center_low_dim": _nearest_to_first(
            k, rounds, seed, "\n    SELECT id, cid, round(d, 9) AS d FROM near", POINTS_3D
        ),
        "vector_arithmetic": f"""
    SELECT id, round(d * d, 9) AS squared, round(d, 9) AS distance FROM (
        SELECT id, list_distance(x, list_transform(x, lambda p: 2 * p - 1)) AS d FROM ({POINTS}))""",
        "center_weights": _nearest_to_first(
            k,
            rounds,
            seed,
            """
    SELECT first.cid, count(near.id) AS weight
    FROM first LEFT JOIN near ON near.cid = first.cid GROUP BY first.cid""",
        ),
        "kmedian_objective": _nearest_to_first(
            k, rounds, seed, "\n    SELECT round(avg(d), 9) AS objective FROM near"
        ),
        "objective_merged": _query(
            [
                f"runs(grp, k) AS (VALUES (0, {k}), (1, 2))",
                _first_centers(k),
                f"base AS (SELECT grp, id, x, 1.0 AS w FROM ({POINTS}), runs)",
                "tried AS (SELECT runs.grp, cid, x FROM first, runs WHERE cid < runs.k)",
                _nearest("base", "tried", "near"),
            ],
            "\n    SELECT grp AS run, round(avg(d), 9) AS objective FROM near GROUP BY grp",
        ),
        "lloyd_step": _query(
            [_base(k, 1, seed, WEIGHT), _first_centers(k), _nearest("base", "first", "near")],
            """
    SELECT cid, CAST(axis - 1 AS INTEGER) AS axis,
           round(sum(w * x[axis]) / sum(w), 9) AS coordinate
    FROM near, unnest(range(1, len(x) + 1)) AS dims(axis) GROUP BY cid, axis""",
        ),
        "lloyd_centers": _query(
            [
                _base(k, rounds, seed, WEIGHT),
                _first_centers(k),
                *_lloyd("base", "first", "final", rounds),
            ],
            AXES.format("final"),
        ),
        "weighted_seeding": _query(
            [_base(k, rounds, seed, WEIGHT), *_seeding("base", "picks", k)],
            "\n    SELECT cid AS pick, id FROM picks",
        ),
        "coreset_weights": _query(
            _coreset(k, parts, rounds, seed),
            """
    SELECT id, w, CAST(axis - 1 AS INTEGER) AS axis, round(x[axis], 9) AS coordinate
    FROM core, unnest(range(1, len(x) + 1)) AS dims(axis)""",
        ),
        "kmedian_coreset": _kmedian_coreset(k, parts, rounds, seed),
        "kmedian_trials": _trials(seed),
        "kmeans_assign": _query(
            [
                _base(k, rounds, seed),
                *_seeding("base", "picks", k, "(d * d)"),
                *_moved("base", "picks", "final", rounds),
                _nearest("base", "final", "near"),
            ],
            "\n    SELECT id, cid AS cluster FROM near",
        ),
        "kmeans_sweep": _kmeans_sweep(SWEEP_KS, rounds, 5.0 * sample, seed),
    }
