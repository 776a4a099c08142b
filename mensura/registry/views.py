"""Derived inputs, written once in SQL that Spark and the oracle engine both run.

They bind the star schema to operator roles: ``events`` become activity records (with nulls, bad numbers, flags, mixed
units and relations taken from the ``k`` property), ship dates become graphs, and so on.
"""

VIEWS: dict[str, str] = {}

VIEWS["records"] = """
SELECT event_id AS source_index,
       CASE WHEN user_id = 7 THEN CAST(NULL AS STRING)
            WHEN k < 50 THEN 'C' || CAST(user_id AS STRING)
            ELSE 'C' || CAST(user_id AS STRING) || '.Cl' END AS canonical_smiles,
       CASE k WHEN 50 THEN 'pIC50' WHEN 51 THEN 'Log IC50' WHEN 52 THEN 'Log IC50(nM)' WHEN 53 THEN 'Ki'
              ELSE 'IC50' END AS standard_type,
       CASE WHEN k < 5 THEN '>' WHEN k < 8 THEN '<' WHEN k = 8 THEN '~' WHEN k = 9 THEN CAST(NULL AS STRING)
            ELSE '=' END AS standard_relation,
       CASE k WHEN 40 THEN 'n/a' WHEN 41 THEN '0' WHEN 42 THEN '-5' ELSE CAST(value AS STRING) END AS standard_value,
       CASE WHEN k = 60 THEN CAST(NULL AS STRING) WHEN event_type = 'click' THEN 'nM'
            WHEN event_type = 'view' THEN '10''3pM' WHEN event_type = 'purchase' THEN '10''5pM'
            WHEN event_type = 'signup' THEN '10''6pM' ELSE 'ug.mL-1' END AS standard_units,
       CASE WHEN k = 20 THEN CAST(NULL AS INT) WHEN k >= 90 THEN 1 ELSE 0 END AS potential_duplicate,
       CASE k WHEN 30 THEN 'Potential transcription error' WHEN 31 THEN 'Outside typical range'
              ELSE CAST(NULL AS STRING) END AS data_validity_comment,
       CASE k WHEN 32 THEN 'Values for this activity type are unusually large/small, so may not be accurate'
              ELSE CAST(NULL AS STRING) END AS data_validity_description,
       event_type AS activity_comment,
       CAST(NULL AS STRING) AS upper_value,
       CAST(user_id AS STRING) AS molecule_chembl_id
FROM (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
      FROM events) e
"""

# Replicate measurements: a finite negative log value per event, two keys without name.
VIEWS["measures"] = """
SELECT event_id AS source_index, nullif(CAST(user_id AS STRING), '7') AS key, event_type AS kind,
       -log10(value * 1e-9) AS x, value AS raw
FROM events
"""

VIEWS["graph_edges"] = """
SELECT DISTINCT CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS graph, p.p_brand AS src, n.n_name AS dst,
       'S' AS label
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
     JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

VIEWS["graph_vertices"] = """
SELECT graph, src AS v, 'B' AS label FROM graph_edges
UNION
SELECT graph, dst AS v, 'N' AS label FROM graph_edges
"""

VIEWS["graph_both"] = """
SELECT graph, src AS a, dst AS b FROM graph_edges UNION ALL SELECT graph, dst AS a, src AS b FROM graph_edges
"""

# Whole-table mean, type mean and key mean of x stand in for three models' predictions.
VIEWS["predictions"] = """
SELECT m.source_index, m.actual, m.overall AS model_overall, m.by_kind AS model_kind, m.by_key AS model_key
FROM (SELECT e.event_id AS source_index, -log10(e.value * 1e-9) AS actual, round(a.m, 6) AS overall,
             round(t.m, 6) AS by_kind, round(u.m, 6) AS by_key
      FROM events e
           JOIN (SELECT event_type, avg(-log10(value * 1e-9)) AS m FROM events GROUP BY event_type) t
                ON e.event_type = t.event_type
           JOIN (SELECT user_id, avg(-log10(value * 1e-9)) AS m FROM events GROUP BY user_id) u
                ON e.user_id = u.user_id
           JOIN (SELECT l, avg(-log10(v * 1e-9)) AS m FROM (SELECT 1 AS l, value AS v FROM events) w GROUP BY l) a
                ON a.l = 1) m
"""

VIEWS["long_predictions"] = """
SELECT source_index, 'overall' AS model, actual, model_overall AS predicted FROM predictions
UNION ALL SELECT source_index, 'kind' AS model, actual, model_kind AS predicted FROM predictions
UNION ALL SELECT source_index, 'key' AS model, actual, model_key AS predicted FROM predictions
"""

# Metric per event type and day: a training history per type.
VIEWS["history"] = """
SELECT event_type AS run, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS epoch,
       round(avg(value), 6) AS metric
FROM events GROUP BY event_type, CAST(ts AS DATE)
"""

# One row per part with a few numbers, as a small feature table with groups.
VIEWS["part_features"] = """
SELECT p.p_partkey AS source_index, p.p_brand || '/' || CAST(p.p_size AS STRING) AS grp, p.p_name AS name,
       CAST(p.p_size AS DOUBLE) AS size, p.p_retailprice AS retail, CAST(l.lines AS DOUBLE) AS lines, l.quantity, l.discount,
       l.price AS target
FROM part p JOIN (SELECT l_partkey, count(*) AS lines, avg(l_quantity) AS quantity, avg(l_discount) AS discount,
                         avg(l_extendedprice) AS price FROM lineitem GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey
"""
