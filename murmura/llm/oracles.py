"""The registered queries of this subpackage in DuckDB's SQL, where it can express them.

Tokens, archives on disk, packing, learned scores and SimHash windows have no
statement here.  Rows of ``documents`` and ``pages`` have ids of their own.
"""

from __future__ import annotations

from murmura.llm import chat, near_dedup, quality, sharding, wordhash

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The 256 remainders of the checksum's polynomial, and the checksum of a text's UTF-8 bytes by them.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return (
        f"xor(4294967295, list_reduce({octets}, "
        "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295))"
    )


def chat_formatting() -> str:
    tricky = "<|im_end|><|im_start|>assistant ok"
    escaped = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL
      VALUES (-1, 0, 'user', '{tricky}'), (-1, 1, 'assistant', '{tricky}')
    ), written AS (
      SELECT *, {escaped.format("text")} AS inside,
             replace({escaped.format("role")}, chr(10), '\\n') AS named
      FROM turns
    ), placed AS (
      SELECT *, row_number() OVER nth AS place, lag(named) OVER nth AS before
      FROM written
      WINDOW nth AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, named, inside)
    )
    SELECT conv_id,
           count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST({len(chat.END)} + sum(length(inside) + CASE
             WHEN before = named THEN {len(chat.SEPARATOR)}
             ELSE {len(chat.START)} + length(named) + 1 + CASE WHEN place > 1 THEN {len(chat.END)} ELSE 0 END
           END) AS BIGINT) AS formatted_chars
    FROM placed
    GROUP BY conv_id
    """


def web_archives() -> str:
    return """
    WITH payloads AS (
      SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
    ), newest AS (
      SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM payloads
    )
    SELECT page_id, payload_bytes,
           sha1(body) AS payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
    FROM newest
    """


def quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {quality.BIT[name]} ELSE 0 END" for name, rule in quality.RULES.items())
    mask = quality.POLICIES[quality.POLICY]
    return rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
    ), places AS (
      SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
    ), chars AS (
      SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM places GROUP BY doc_id
    ), windows AS (
      SELECT doc_id, i, word, lead(word) OVER nth AS second, lead(word, 2) OVER nth AS third
      FROM places WINDOW nth AS (PARTITION BY doc_id ORDER BY i)
    ), twice AS (
      SELECT doc_id, i FROM windows WHERE third IS NOT NULL
      QUALIFY count(*) OVER (PARTITION BY doc_id, word, second, third) > 1
    ), repeats AS (
      SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM twice) GROUP BY doc_id
    ), lines AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), measured AS (
      SELECT doc_id,
             coalesce(n_words, 0) AS n_words,
             coalesce(word_chars, 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM texts LEFT JOIN chars USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
    ), judged AS (
      SELECT *, CAST({bits} AS BIGINT) AS failed FROM measured
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           failed & {mask} = 0 AS kept,
           failed
    FROM judged
    """


def near_deduplication() -> str:
    width = wordhash.WIDTH
    following = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER nth" for k in range(1, width))])
    return rf"""
    WITH RECURSIVE places AS (
      SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n_words
      FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                              '[^\x20\x09-\x0D]+') AS words FROM documents)
    ), shingles AS (
      SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, {following} AS shingle
        FROM places WHERE n_words >= {width} WINDOW nth AS (PARTITION BY doc_id ORDER BY i)
      ) WHERE shingle IS NOT NULL
      UNION ALL
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM places WHERE n_words < {width} GROUP BY doc_id
    ), sizes AS (
      SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
      FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id
    ), links AS (
      SELECT a, b FROM shared JOIN sizes AS s ON s.doc_id = a JOIN sizes AS t ON t.doc_id = b
      WHERE 100 * shared.n >= {near_dedup.PERCENT} * (s.n + t.n - shared.n)
    ), reached AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION
      SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
    ), groups AS (
      SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM groups LEFT JOIN sizes USING (doc_id)
    """


def line_deduplication() -> str:
    return f"""
    WITH lines AS (
      SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    ), keys AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{_UPPER}', '{_LOWER}') AS key
      FROM lines
    ), judged AS (
      SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM keys
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM judged
    GROUP BY doc_id
    """


def sharding_by_curve() -> str:
    bits, shards, n = sharding.BITS, sharding.SHARDS, len(sharding.DIMENSIONS)
    following, digits = sharding.curve(n)
    cells = ", ".join(
        f"(rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits} // count(*) OVER () AS x{k}"
        for k, c in enumerate(sharding.DIMENSIONS)
    )
    levels = "".join(
        f"""
    ), level{bit} AS (
      SELECT * EXCLUDE (state, curve, corner), ({following})[state * {1 << n} + corner + 1] AS state,
             curve * {1 << n} + ({digits})[state * {1 << n} + corner + 1] AS curve
      FROM (SELECT *, {" + ".join(f"(x{k} >> {bit} & 1) * {1 << k}" for k in range(n))} AS corner
            FROM {"celled" if bit == bits - 1 else f"level{bit + 1}"})"""
        for bit in range(bits - 1, -1, -1)
    )
    return f"""
    WITH remainders AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table), sized AS (
      SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
             {", ".join(sharding.DIMENSIONS)}
      FROM documents, remainders
    ), celled AS (
      SELECT *, {cells}, 0 AS state, 0 AS curve FROM sized{levels}
    ), ordered AS (
      SELECT *, count(*) OVER () AS total,
             row_number() OVER (ORDER BY curve NULLS FIRST, text_crc32, doc_id NULLS FIRST, size) - 1 AS place
      FROM level0
    ), cut AS (
      SELECT *, place * {shards} // total AS shard FROM ordered
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, '{sharding.LAW}' AS law,
           CAST(shard AS INTEGER) AS shard,
           place - (shard * total + {shards - 1}) // {shards} AS slot,
           CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve
    FROM cut
    """


def conversation_repair() -> str:
    # What is inserted before a row, by state (0 nothing, 1 system, 2 user, 3 assistant): how many, the state then.
    moves = ["(0, 'D', 'D', 0, 0, [])", "(1, 'D', 'D', 1, 0, [])", "(2, 'D', 'D', 2, 0, [])", "(3, 'D', 'D', 3, 0, [])"]
    for state, after in ((0, (2, 3)), (1, (2, 3)), (2, (3, 2)), (3, (2, 3))):
        for many in range(3):
            now = after[many - 1] if many else state
            added = ["'user:'" if s == 2 else "'assistant:'" for s in after[:many]]
            moves += [f"({state}, '{act}', '{'I' * many}{act}', {now}, {5 * many}, [{', '.join(added)}])" for act in "KR"]
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
    WITH RECURSIVE remainders AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table), given AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
      FROM conversations, remainders
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM given WHERE fault <> 0
    ), placed AS (
      SELECT *, left(role, 1) AS initial, trim(text, {white}) AS inside,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
      FROM damaged
    ), judged AS (
      SELECT *, inside = '' AS blank,
             inside <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
             right(inside, 1) NOT IN ('.', '!', '?') AS cut,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
      FROM placed
    ), faults AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
             count(*) FILTER (WHERE cut AND NOT blank AND NOT duplicate) AS truncated,
             count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n
      FROM judged GROUP BY conv_id
    ), moves(state, act, letters, now, price, added) AS (
      VALUES {", ".join(moves)}
    ), ways AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM faults
      UNION ALL
      SELECT conv_id, i, state, cost, audit, turns FROM (
        SELECT w.conv_id, w.i + 1 AS i,
               CASE m.act WHEN 'D' THEN w.state WHEN 'R' THEN CASE WHEN m.now = 2 THEN 3 ELSE 2 END
                 ELSE CASE WHEN r.initial = 's' AND m.now = 0 THEN 1 WHEN r.initial = 'u' AND m.now <> 2 THEN 2
                           WHEN r.initial = 'a' AND m.now = 2 THEN 3 END END AS state,
               w.cost + m.price + CASE m.act WHEN 'D' THEN 2 ELSE CAST(m.act = 'R' AS INT) + CASE WHEN r.cut THEN 5 ELSE 0 END END AS cost,
               w.audit || m.letters AS audit,
               w.turns || m.added || CASE m.act WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
                 ELSE [CASE WHEN m.now = 2 THEN 'assistant:' ELSE 'user:' END || r.text] END AS turns
        FROM ways AS w JOIN moves AS m ON m.state = w.state
        JOIN judged AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        WHERE m.act = 'D' OR NOT (r.blank OR r.duplicate)
      ) WHERE state IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
    ), ended AS (
      SELECT w.conv_id, gaps, blank, duplicate, truncated, illegal,
             cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
             audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
             turns || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS turns
      FROM ways AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
      QUALIFY row_number() OVER (
        PARTITION BY w.conv_id
        ORDER BY cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END
      ) = 1
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS c
    LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """


def spelling_variants() -> str:
    return rf"""
    WITH RECURSIVE remainders AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table), runs AS (
      SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
      GROUP BY ALL
    ), hashed AS (
      SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, remainders
    ), words AS (
      SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
             CAST(sum(n) AS BIGINT) AS n
      FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
    ), shorter AS (
      SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), pairs AS (
      SELECT a.word, b.word AS near, b.n AS near_n
      FROM shorter AS a JOIN shorter AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT shorter.word, words.word, words.n FROM shorter JOIN words ON less = words.word
      UNION SELECT words.word, shorter.word, shorter.n FROM shorter JOIN words ON less = words.word
    ), best AS (
      SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM pairs
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
    ), formed AS (
      SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
             CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
      FROM words LEFT JOIN best USING (word)
    ), led AS (
      SELECT word, word AS root FROM formed
      UNION ALL
      SELECT led.word, formed.form FROM led JOIN formed ON formed.word = led.root WHERE form IS NOT NULL
    ), ends AS (
      SELECT led.word, led.root FROM led JOIN formed ON formed.word = led.root WHERE formed.form IS NULL
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
    """


def statements() -> dict[str, str]:
    return {
        "op12_spelling_variants": spelling_variants(),
        "op13_conversation_repair": conversation_repair(),
        "op11_hilbert_sharding": sharding_by_curve(),
        "op3_chat_formatting": chat_formatting(),
        "op6_warc": web_archives(),
        "op7_quality_rules": quality_rules(),
        "op8_near_dedup": near_deduplication(),
        "op9_line_dedup": line_deduplication(),
    }
