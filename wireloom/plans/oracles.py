"""The same results in plain SQL, written flow by flow and independently of the operators."""

from __future__ import annotations

from wireloom.schema import EDGE, FEATURES, FLOW, PLAIN_FEATURES, SCAN_COLUMNS
from wireloom.sources.order_flows import COLUMNS, STAND_IN_PROB

# Words of malicious labels, written out so that a wrong pattern in the operator shows.
MALICIOUS_WORDS = r"\b(bot|botnet|cnc|c&c|malware|infected|attack|spam|ddos|trojan|worm|zombie|backdoor)\b"

_scan = ", ".join(SCAN_COLUMNS)
_edge = ", ".join(EDGE)


def _six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _host_side(side: str, address: str, columns: list[str] = FEATURES) -> str:
    parts = [f"avg(CAST({f} AS DOUBLE)) AS {side}_{f}_mean, count({f}) AS {side}_{f}_count" for f in columns]
    own = {"src": "SrcTotalWeight", "dst": "DstTotalWeight"}[side]
    count = {"src": "out_count", "dst": "in_count"}[side]
    return (
        f"SELECT SensorId, {address} AS node, {', '.join(parts)}, count(*) AS {count},"
        f" avg(CAST({own} AS DOUBLE)) AS {side}_total_weight_agg FROM features GROUP BY 1, 2"
    )


def _host_names(columns: list[str] = FEATURES) -> list[str]:
    names = [f"{s}_{f}_{k}" for s in ("src", "dst") for f in columns for k in ("mean", "count")]
    return names + ["in_count", "out_count", "src_total_weight_agg", "dst_total_weight_agg"]


def _host_columns(columns: list[str] = FEATURES) -> str:
    return ", ".join(f"coalesce({n}, 0) AS {n}" for n in _host_names(columns))


def _single(names: list[str]) -> str:
    """As catalog.single."""
    return ", ".join(f"CAST(CAST({n} AS FLOAT) AS DOUBLE) AS {n.split('.')[-1]}" for n in names)


# Each entry may use the ones before it.
TABLES = {
    "flows": "SELECT " + ", ".join(f"{text} AS {name}" for name, text in COLUMNS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "valid": "SELECT * FROM flows WHERE Label IS NOT NULL AND regexp_matches(SrcAddr, '^[0-9.]+$')",
    "labelled": rf"""
        SELECT * EXCLUDE (Label),
            regexp_matches(lower(Label), 'from[-_]?botnet') AS LabelFromBotnet,
            regexp_matches(lower(Label), 'to[-_]?botnet') AS LabelToBotnet,
            contains(lower(Label), 'botnet') AS LabelBotnet,
            CASE WHEN regexp_matches(lower(Label), 'to[-_]?botnet') THEN 1 ELSE 0 END AS LabelCNC,
            CASE WHEN TRY_CAST(Label AS DOUBLE) IS NOT NULL THEN CAST(TRY_CAST(Label AS DOUBLE) >= 0.5 AS INTEGER)
                WHEN regexp_matches(Label, '{MALICIOUS_WORDS}', 'i') THEN 1 ELSE 0 END AS Label
        FROM valid""",
    "scored": f"SELECT *, {STAND_IN_PROB} AS prob FROM labelled",
    "pairs": "SELECT SrcAddr, DstAddr, count(*) AS EdgeWeight FROM labelled GROUP BY 1, 2",
    "weighted": """
        SELECT s.*, p.EdgeWeight,
            CAST(sum(p.EdgeWeight) OVER (PARTITION BY s.SrcAddr) AS DOUBLE) AS SrcTotalWeight,
            CAST(sum(p.EdgeWeight) OVER (PARTITION BY s.DstAddr) AS DOUBLE) AS DstTotalWeight
        FROM scored s JOIN pairs p ON s.SrcAddr = p.SrcAddr AND s.DstAddr = p.DstAddr""",
    "proto": "SELECT Proto, CAST(row_number() OVER (ORDER BY Proto) - 1 AS INTEGER) AS code, rows"
    " FROM (SELECT Proto, count(*) AS rows FROM labelled GROUP BY 1)",
    "state": "SELECT State, CAST(row_number() OVER (ORDER BY State) - 1 AS INTEGER) AS code, rows"
    " FROM (SELECT coalesce(State, 'None') AS State, count(*) AS rows FROM labelled GROUP BY 1)",
    "features": """
        SELECT w.* REPLACE (
                CASE w.Dir WHEN '->' THEN 1 WHEN '<-' THEN -1 ELSE 0 END AS Dir, p.code AS Proto),
            TotBytes / CAST(TotPkts + 1 AS DOUBLE) AS ByteRatio,
            TotPkts / (Dur + CAST(0.1 AS DOUBLE)) AS DurationRate,
            SrcBytes / CAST(TotBytes + 1 AS DOUBLE) AS FlowIntensity,
            TotPkts / CAST(TotBytes + 1 AS DOUBLE) AS PktByteRatio,
            SrcBytes / CAST(TotBytes + 1 AS DOUBLE) AS SrcByteRatio,
            abs(sTos - dTos) AS TrafficBalance,
            Dur / CAST(TotPkts + 1 AS DOUBLE) AS DurationPerPkt,
            TotBytes / (Dur + 1) AS Intensity
        FROM weighted w JOIN proto p ON w.Proto = p.Proto""",
    "matrix": "SELECT SensorId, SrcAddr, DstAddr, Label, LabelCNC, "
    + ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in FEATURES)
    + " FROM features",
    "edges": "SELECT SensorId, SrcAddr, DstAddr, count(*) AS w_sensor, any_value(EdgeWeight) AS w_global,"
    " CAST(sum(EdgeWeight) AS DOUBLE) AS edge_weight_sum, sum(prob) AS sum_prob FROM weighted GROUP BY 1, 2, 3",
    "incoming": "SELECT SensorId, DstAddr AS node, count(prob) AS in_ct, avg(prob) AS in_prob,"
    " count(DISTINCT SrcAddr) AS in_unique_srcs, CAST(sum(EdgeWeight) AS DOUBLE) AS dst_total_weight,"
    " max(LabelCNC) = 1 AS label_cnc FROM weighted GROUP BY 1, 2",
    "outgoing": "SELECT SensorId, SrcAddr AS node, count(prob) AS out_ct, avg(prob) AS out_prob,"
    " count(DISTINCT DstAddr) AS out_unique_dests, CAST(sum(EdgeWeight) AS DOUBLE) AS src_total_weight"
    " FROM weighted GROUP BY 1, 2",
    "stats": """
        SELECT SensorId, node, coalesce(in_ct, 0) AS in_ct, coalesce(in_prob, 0) AS in_prob,
            coalesce(out_ct, 0) AS out_ct, coalesce(out_prob, 0) AS out_prob,
            coalesce(out_unique_dests, 0) AS out_unique_dests, coalesce(in_unique_srcs, 0) AS in_unique_srcs,
            coalesce(src_total_weight, 0) AS src_total_weight, coalesce(dst_total_weight, 0) AS dst_total_weight,
            coalesce(label_cnc, false) AS label_cnc
        FROM incoming FULL JOIN outgoing USING (SensorId, node)""",
    "ratios": """
        SELECT *, in_ct + out_ct AS degree, in_ct / (in_ct + out_ct + CAST(1e-9 AS DOUBLE)) AS in_ratio,
            out_ct / (in_ct + out_ct + CAST(1e-9 AS DOUBLE)) AS out_ratio
        FROM stats""",
    "sensors": """
        SELECT SensorId, n_nodes, w_out, 1 - w_out AS w_in FROM (
            SELECT SensorId, count(*) AS n_nodes, CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE)
                * (avg(out_prob) / (avg(out_prob) + avg(in_prob) + CAST(1e-9 AS DOUBLE))) AS w_out
            FROM stats GROUP BY 1)""",
    "probable": "SELECT r.*, s.w_out, s.w_in, out_prob * w_out + in_prob * w_in AS cnc_prob"
    " FROM ratios r JOIN sensors s USING (SensorId)",
    "nodes": """
        SELECT *, cnc_prob * (1 + CAST(1.8 AS DOUBLE) * out_ratio + CAST(0.8 AS DOUBLE) * in_ratio)
            * ln(1 + degree) * ln(2 + out_unique_dests) * ln(2 + src_total_weight) AS cnc_score
        FROM probable""",
    "limits": """
        SELECT SensorId, any_value(w_out) AS w_out, any_value(w_in) AS w_in,
            CASE WHEN count(*) > 1 THEN greatest(CAST(0.4 AS DOUBLE), least(CAST(0.95 AS DOUBLE),
                avg(cnc_prob) + CAST(1.5 AS DOUBLE) * stddev_samp(cnc_prob))) END AS strict_thr,
            greatest(CAST(0 AS DOUBLE), quantile_cont(cnc_score, 0.95)) AS p95
        FROM nodes GROUP BY 1""",
    "hits": """
        SELECT n.* EXCLUDE (w_out, w_in), l.p95,
            coalesce(cnc_prob > strict_thr AND out_ct > 120 AND out_ratio > 0.70, false) AS strict,
            cnc_score >= p95 AND cnc_prob >= 0.40 AND out_ct >= 20 AS percentile
        FROM nodes n JOIN limits l USING (SensorId)""",
    "ruled": "SELECT *, strict OR percentile OR label_cnc AS flagged,"
    " CASE WHEN strict OR percentile OR label_cnc THEN 'C&C' ELSE 'Normal' END AS Role FROM hits",
    "ends": "SELECT SensorId, SrcAddr AS node FROM edges UNION ALL SELECT SensorId, DstAddr FROM edges",
    "degrees": "SELECT SensorId, node, count(*) AS graph_degree FROM ends GROUP BY 1, 2",
    "flagged": "SELECT SensorId, node, cnc_score FROM ruled WHERE flagged",
    "around": """
        SELECT e.SensorId, e.DstAddr AS node FROM edges e
            JOIN flagged f ON e.SensorId = f.SensorId AND e.SrcAddr = f.node
        UNION
        SELECT e.SensorId, e.SrcAddr FROM edges e
            JOIN flagged f ON e.SensorId = f.SensorId AND e.DstAddr = f.node""",
    "others": "SELECT a.* FROM around a ANTI JOIN flagged f USING (SensorId, node)",
}


def _kept(max_nodes: int, max_edges: int) -> dict[str, str]:
    return {
        "kept": f"""
            SELECT SensorId, node, true AS is_flagged FROM flagged
            UNION ALL
            SELECT SensorId, node, false FROM (
                SELECT o.SensorId, o.node, c.taken,
                    row_number() OVER (PARTITION BY o.SensorId ORDER BY graph_degree DESC, o.node) AS place
                FROM others o JOIN degrees USING (SensorId, node)
                JOIN (SELECT SensorId, count(*) AS taken FROM flagged GROUP BY 1) c USING (SensorId))
            WHERE place + taken <= {max_nodes}""",
        "leaders": "SELECT SensorId, node, row_number() OVER (PARTITION BY SensorId ORDER BY cnc_score DESC, node)"
        " AS place FROM flagged",
        "kept_edges": f"""
            SELECT SensorId, src, dst, weight FROM (
                SELECT e.SensorId, e.SrcAddr AS src, e.DstAddr AS dst, e.w_sensor AS weight,
                    row_number() OVER (PARTITION BY e.SensorId ORDER BY
                        CASE WHEN a.is_flagged OR b.is_flagged THEN 0 ELSE 1 END,
                        e.w_sensor DESC, e.SrcAddr, e.DstAddr) AS place
                FROM edges e JOIN kept a ON e.SensorId = a.SensorId AND e.SrcAddr = a.node
                JOIN kept b ON e.SensorId = b.SensorId AND e.DstAddr = b.node)
            WHERE place <= {max_edges}""",
    }


HOSTS = {
    "as_source": _host_side("src", "SrcAddr"),
    "as_target": _host_side("dst", "DstAddr"),
    "hosts": f"SELECT SensorId, node, {_host_columns()} FROM as_source FULL JOIN as_target USING (SensorId, node)",
}

GRAPH_NODES = """
    SELECT k.SensorId, k.node, CASE WHEN l.place <= 4 THEN 'top' WHEN k.is_flagged THEN 'candidate'
        ELSE 'normal' END AS tier, d.graph_degree{score}
    FROM kept k JOIN degrees d USING (SensorId, node) JOIN ruled r USING (SensorId, node)
    LEFT JOIN leaders l USING (SensorId, node)"""

ROC = {
    "tally": "SELECT prob AS threshold, count(*) FILTER (Label = 1) AS pos, count(*) FILTER (Label = 0) AS neg"
    " FROM scored GROUP BY 1",
    "curve": """
        SELECT *, CAST(sum(pos) OVER down AS BIGINT) AS pos_upto, CAST(sum(neg) OVER down AS BIGINT) AS neg_upto,
            CAST(sum(pos) OVER down AS DOUBLE) / (SELECT sum(pos) FROM tally) AS tpr,
            CAST(sum(neg) OVER down AS DOUBLE) / (SELECT sum(neg) FROM tally) AS fpr,
            row_number() OVER down = 1 OR pos IS DISTINCT FROM lead(pos) OVER down
                OR neg IS DISTINCT FROM lead(neg) OVER down AS corner
        FROM tally WINDOW down AS (ORDER BY threshold DESC)""",
}

_regression = """
    SELECT avg((y - p) * (y - p)) AS MSE, sqrt(avg((y - p) * (y - p))) AS RMSE, avg(abs(y - p)) AS MAE,
        1 - avg((y - p) * (y - p)) / var_pop(y) AS R2
    FROM (SELECT CAST(Label AS DOUBLE) AS y, greatest(prob - CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE)) AS p FROM scored)"""


_checked = """
    SELECT SensorId, count(*) AS flows, CAST(sum(TotBytes) AS BIGINT) AS total_bytes, CAST(0 AS BIGINT) AS bad,
        CAST(0 AS BIGINT) AS mislabelled, true AS separates
    FROM scored GROUP BY 1"""


def _ingest_report() -> str:
    """Headers at multiples of 50, no StartTime at 7 beyond them; what the query spoils, and nulls of the flows themselves."""
    body = "Sport % 50 <> 0"
    source = "regexp_matches(SrcAddr, '^[0-9.]+$')"
    bytes_gone = "Sport % 13 = 4"
    spoilt = {"StartTime": "Sport % 17 = 5", "TotBytes": bytes_gone, "SrcBytes": "Sport % 11 = 3"}
    counts = {("read", None): "true", ("repeated header", None): "Sport % 50 = 0"}
    counts |= {("unparsable", c): f"{body} AND {spoilt.get(c, 'false')}" for c in FLOW.names}
    counts |= {
        ("without label", None): f"{body} AND Label IS NULL",
        ("bad source", None): f"{body} AND Label IS NOT NULL AND NOT {source}",
        ("incomplete", None): f"{body} AND Label IS NOT NULL AND {source} AND {bytes_gone}",
        ("kept", None): f"{body} AND Label IS NOT NULL AND {source} AND NOT ({bytes_gone})",
    }
    return " UNION ALL ".join(
        f"SELECT '{step}' AS step, CAST({f"'{column}'" if column else 'NULL'} AS VARCHAR) AS column, count(*) FILTER ({test}) AS rows FROM flows"
        for (step, column), test in counts.items()
    )


def _type_report() -> str:
    types = {
        "StartTime": "VARCHAR", "Dur": "DOUBLE", "Proto": "VARCHAR", "SrcAddr": "VARCHAR", "Sport": "DOUBLE", "Dir": "VARCHAR",
        "DstAddr": "VARCHAR", "Dport": "BIGINT", "State": "VARCHAR", "sTos": "DOUBLE", "dTos": "DOUBLE", "TotPkts": "BIGINT",
        "TotBytes": "BIGINT", "SrcBytes": "VARCHAR", "Label": "VARCHAR", "ActivityLabel": "BOOLEAN", "BotnetName": "VARCHAR",
        "SensorId": "BIGINT",
    }
    # Label holds a few numbers among words; the others hold no value of any type but text.
    conflicts = {
        "StartTime": "Sport % 9 = 4", "SrcBytes": "Sport % 9 = 4",
        "Label": "TRY_CAST(Label AS DOUBLE) IS NULL AND Label IS NOT NULL",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"Column\", '{t}' AS \"Type\", {'CAST(0 AS BIGINT)' if c == 'BotnetName' else f'count({c})'} AS values,"
        f" {'count(*)' if c == 'BotnetName' else f'count(*) - count({c})'} AS nulls,"
        f" count(*) FILTER ({conflicts.get(c, 'false')}) AS conflicts FROM flows"
        for c, t in types.items()
    )


def _sql(final: str, extra: dict[str, str] | None = None) -> str:
    tables = {**TABLES, **(extra or {})}
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in tables.items())
    return f"WITH {ctes}\n{final}"


def _draw(text: str) -> str:
    return f"substr(md5({text} || '|42'), 1, 16)"


#: A flow as a text; catalog.flow_text.
FLOW_TEXT = "concat_ws('|', " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '-')" for c in (
        "SensorId", "SrcAddr", "DstAddr", "Proto", "Dir", "State", "TotBytes", "TotPkts", "SrcBytes", "Label", "LabelCNC",
        "CAST(round(Dur * 10000) AS BIGINT)", "CAST(sTos AS BIGINT)", "CAST(dTos AS BIGINT)",
    )
) + ")"

#: Nodes of the older rule, up to 200 neighbours drawn, then up to 400 edges drawn among them.
RANDOM_GRAPH = {
    "accused": """
        SELECT SensorId, node FROM ratios
        WHERE (in_prob + out_prob) / 2 > 0.70 AND degree > 110 AND out_ratio > 0.70""",
    "beside": """
        SELECT e.SensorId, e.DstAddr AS node FROM edges e JOIN accused a ON e.SensorId = a.SensorId AND e.SrcAddr = a.node
        UNION
        SELECT e.SensorId, e.SrcAddr FROM edges e JOIN accused a ON e.SensorId = a.SensorId AND e.DstAddr = a.node""",
    "drawn": f"""
        SELECT SensorId, node FROM accused
        UNION ALL
        SELECT SensorId, node FROM (
            SELECT b.SensorId, b.node, row_number() OVER (PARTITION BY b.SensorId ORDER BY
                {_draw("b.SensorId || '|' || b.node")}, b.node) AS place
            FROM beside b ANTI JOIN accused a USING (SensorId, node))
        WHERE place <= 200""",
    "drawn_edges": f"""
        SELECT e.SensorId, e.SrcAddr AS src, e.DstAddr AS dst, e.w_sensor AS weight, row_number() OVER (PARTITION BY e.SensorId
            ORDER BY {_draw("e.SensorId || '|' || e.SrcAddr || '|' || e.DstAddr")}, e.SrcAddr, e.DstAddr) AS place
        FROM edges e JOIN drawn a ON e.SensorId = a.SensorId AND e.SrcAddr = a.node
        JOIN drawn b ON e.SensorId = b.SensorId AND e.DstAddr = b.node""",
}


def _means(columns: list[str], source: str) -> str:
    averaged = ", ".join(f"coalesce(avg(a.{c}), 0) AS {c}" for c in columns)
    return (
        f"SELECT h.SensorId, h.node, {averaged} FROM hosts h LEFT JOIN ("
        f"SELECT e.SensorId, e.DstAddr, s.* EXCLUDE (SensorId, node) FROM edges e JOIN {source} s"
        " ON e.SensorId = s.SensorId AND e.SrcAddr = s.node) a"
        " ON h.SensorId = a.SensorId AND h.node = a.DstAddr GROUP BY 1, 2"
    )


def oracle_sql() -> dict[str, str]:
    text_cells = ", ".join(
        f"CASE WHEN Sport % 50 = 0 THEN '{c}'"
        + (" WHEN Sport % 50 = 7 THEN NULL" if c == "StartTime" else "")
        + f" ELSE CAST({c} AS VARCHAR) END AS {c}"
        for c in ("StartTime", "SrcAddr", "DstAddr", "Sport")
    )
    clean_cells = ", ".join(
        f"CASE WHEN Sport % 50 = 7 THEN NULL ELSE {c} END AS {c}" if c == "StartTime" else c for c in FLOW.names
    )
    found = {
        "flows_valid": f"SELECT {_scan} FROM valid",
        "flows_one_sensor": f"SELECT {_scan} FROM valid WHERE SensorId = 3",
        "complete_flows": f"""
            SELECT {_scan} FROM (
                SELECT * REPLACE (nullif(Proto, 'icmp') AS Proto,
                    CASE WHEN TotPkts % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE Dur END AS Dur) FROM flows)
            WHERE Proto IS NOT NULL AND Dur IS NOT NULL AND NOT isnan(Dur) AND Label IS NOT NULL
                AND SrcAddr IS NOT NULL AND DstAddr IS NOT NULL AND Dir IS NOT NULL
                AND TotBytes IS NOT NULL AND TotPkts IS NOT NULL""",
        "repeated_headers": f"SELECT * FROM (SELECT {text_cells} FROM flows)"
        " WHERE StartTime IS DISTINCT FROM 'StartTime'",
        "header_report": "SELECT count(*) FILTER (Sport % 50 <> 0) AS kept,"
        " count(*) FILTER (Sport % 50 = 0) AS removed FROM flows",
        "header_lines": "SELECT count(*) AS headers, count(*) = 1 AS ok FROM flows WHERE Sport % 50 = 0",
        "converted_flows": f"SELECT {clean_cells} FROM flows WHERE Sport % 50 <> 0",
        "converted_shape": "SELECT count(*) AS rows, 18 AS columns FROM flows WHERE Sport % 50 <> 0",
        "bot_flow_count": "SELECT count(*) AS flows FROM flows"
        " WHERE Label LIKE '%Bot%' AND trim(Dir) = '->' AND SensorId = 2",
        "cnc_labels": f"SELECT {_edge}, LabelFromBotnet, LabelToBotnet, LabelBotnet, LabelCNC FROM scored",
        "binary_label": f"SELECT {_edge}, TotBytes, Label FROM scored",
        "label_counts": "SELECT 'Label' AS column, Label AS value, count(*) AS flows FROM scored GROUP BY 2"
        " UNION ALL SELECT 'LabelCNC', LabelCNC, count(*) FROM scored GROUP BY 2",
        "flow_summary": "SELECT count(*) AS flows, count(DISTINCT SensorId) AS sensors FROM scored",
        "dir_code": "SELECT Dir AS Dir_raw, CASE Dir WHEN '->' THEN 1 WHEN '<-' THEN -1 ELSE 0 END AS code,"
        " CASE trim(Dir) WHEN '->' THEN 1 WHEN '<-' THEN -1 ELSE 0 END AS trimmed_code, count(*) AS flows"
        " FROM scored GROUP BY Dir",
        "proto_codes": "SELECT 'Proto' AS column, Proto AS value, code, rows FROM proto"
        " UNION ALL SELECT 'State', State, code, rows FROM state",
        "ratio_features": f"SELECT {_edge}, {', '.join(PLAIN_FEATURES[8:])} FROM features",
        "matrix_clean": "SELECT * FROM matrix",
        "scaled_features": "SELECT "
        + ", ".join(f"round(({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1), 4) AS {f}" for f in FEATURES)
        + " FROM matrix",
        "edge_weights": "SELECT * FROM pairs",
        "flow_weights": f"SELECT {_edge}, TotBytes, EdgeWeight, SrcTotalWeight, DstTotalWeight FROM weighted",
        "flow_weights_split": f"SELECT {_edge}, TotBytes, EdgeWeight, SrcTotalWeight, DstTotalWeight FROM weighted",
        "host_check": "SELECT SensorId, count(*) AS nodes, CAST(0 AS BIGINT) AS bad FROM stats GROUP BY 1",
        "sensor_edges": "SELECT * FROM edges",
        "node_in_out": "SELECT SensorId, node, in_ct, in_prob, out_ct, out_prob FROM stats",
        "node_unique_peers": "SELECT SensorId, node, out_unique_dests, in_unique_srcs FROM stats",
        "node_weights": "SELECT SensorId, node, src_total_weight, dst_total_weight FROM stats",
        "sensor_weights": f"SELECT SensorId, n_nodes, {_six('w_out', 'w_in')} FROM sensors",
        "node_scores": "SELECT SensorId, node, degree, "
        + _six("in_ratio", "out_ratio", "cnc_prob", "cnc_score") + " FROM nodes",
        "fixed_rule": "SELECT SensorId, node, round((in_prob + out_prob) / 2, 6) AS avg_prob, "
        + _six("in_ratio", "out_ratio")
        + ", degree, CASE WHEN (in_prob + out_prob) / 2 > 0.70 AND degree > 110 AND out_ratio > 0.70"
        " THEN 'C&C' ELSE 'Normal' END AS Role FROM ratios",
        "node_scores_simple": "SELECT SensorId, node, round((in_prob + out_prob) / 2 * (1 + in_ratio + out_ratio)"
        " * ln(1 + degree), 6) AS cnc_score FROM ratios"
        " WHERE (in_prob + out_prob) / 2 > 0.70 AND degree > 110 AND out_ratio > 0.70",
        "strict_threshold": f"SELECT SensorId, {_six('strict_thr')} FROM limits",
        "score_cutoff": f"SELECT SensorId, {_six('p95')} FROM limits",
        "node_rules": "SELECT SensorId, node, strict, percentile, label_cnc, flagged, Role FROM ruled",
        "node_reasons": """
            SELECT SensorId, node, Role, CASE WHEN flagged THEN concat_ws(';',
                CASE WHEN strict THEN 'strict_rule' END,
                CASE WHEN percentile THEN printf('score>=p95 (>= %.4f)', p95) END,
                CASE WHEN label_cnc THEN 'label_cnc' END,
                CASE WHEN out_ratio > 0.8 THEN 'high_out_ratio' END,
                CASE WHEN out_ct > 200 THEN 'very_high_out_ct' END,
                CASE WHEN src_total_weight > 500 THEN 'high_src_total_weight' END) ELSE '' END AS Reason
            FROM ruled""",
        "no_ground_truth": "SELECT SensorId, node, CASE WHEN strict OR percentile THEN 'C&C' ELSE 'Normal' END AS Role"
        " FROM ruled",
        "detection_summary": f"""
            SELECT SensorId, {_six('w_out', 'w_in', 'strict_thr', 'l.p95').replace('AS l.p95', 'AS p95')},
                count(*) FILTER (strict) AS n_strict, count(*) FILTER (percentile) AS n_percentile,
                count(*) FILTER (label_cnc) AS n_truth, count(*) FILTER (flagged) AS n_flagged
            FROM ruled r JOIN limits l USING (SensorId) GROUP BY SensorId, w_out, w_in, strict_thr, l.p95""",
        "flagged_nodes": f"SELECT SensorId, node, in_ct, out_ct, {_six('cnc_prob', 'cnc_score')}, Role"
        " FROM ruled WHERE flagged",
        "top5_nodes": "SELECT SensorId, node, rank, round(cnc_score, 6) AS cnc_score FROM (SELECT *, CAST(row_number()"
        " OVER (PARTITION BY SensorId ORDER BY cnc_score DESC, node) AS INTEGER) AS rank FROM nodes) WHERE rank <= 5",
        "top5_flagged": "SELECT SensorId, node, rank, round(cnc_score, 6) AS cnc_score FROM (SELECT *, CAST(row_number()"
        " OVER (PARTITION BY SensorId ORDER BY cnc_score DESC, node) AS INTEGER) AS rank FROM flagged) WHERE rank <= 5",
        "vertices": "SELECT DISTINCT SensorId, node FROM ends",
        "graph_degree": "SELECT * FROM degrees",
        "neighbours": "SELECT * FROM others",
        "node_labels": "SELECT SensorId, node, max(LabelCNC) AS label_cnc FROM"
        " (SELECT SensorId, SrcAddr AS node, LabelCNC FROM scored"
        " UNION ALL SELECT SensorId, DstAddr, LabelCNC FROM scored) GROUP BY 1, 2",
        "score_join_back": f"""
            SELECT {_edge}, TotBytes, round(p, 6) AS PredictedProb, CAST(p >= 0.5 AS INTEGER) AS PredictedLabel
            FROM (SELECT s.*, greatest(coalesce(a.in_prob, 0), coalesce(b.in_prob, 0)) AS p FROM scored s
                LEFT JOIN stats a ON s.SensorId = a.SensorId AND s.SrcAddr = a.node AND a.in_ct > 5
                LEFT JOIN stats b ON s.SensorId = b.SensorId AND s.DstAddr = b.node AND b.in_ct > 5)""",
        "class_weights": "SELECT Label, round((SELECT count(*) FROM scored) / (count(*) *"
        " (SELECT CAST(count(DISTINCT Label) AS DOUBLE) FROM scored)), 6) AS weight FROM scored GROUP BY 1",
        "split_counts": """
            SELECT Label, split, CAST(CASE split WHEN 'train' THEN train ELSE n - train END AS BIGINT) AS flows FROM (
                SELECT Label, n, floor_part + CASE WHEN row_number() OVER (ORDER BY rest DESC, Label)
                    <= total_train - sum(floor_part) OVER () THEN 1 ELSE 0 END AS train
                FROM (SELECT *, total_train * n // total AS floor_part, total_train * n % total AS rest FROM (
                    SELECT Label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
                        CAST(sum(count(*)) OVER () AS BIGINT) - (sum(count(*)) OVER () * 3 + 9) // 10 AS total_train
                    FROM scored GROUP BY 1)))
            CROSS JOIN (VALUES ('train'), ('test')) v(split)""",
        "sample_rows": f"""
            SELECT {_edge}, TotBytes, Label FROM (
                SELECT *, row_number() OVER (ORDER BY {_draw("concat_ws('|', SensorId, SrcAddr, DstAddr, TotBytes, Label)")}) AS place,
                    count(*) OVER () AS n FROM scored)
            WHERE place <= n // 4""",
        "class_metrics": """
            SELECT round(100.0 * (tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
                round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1
            FROM (SELECT CAST(count(*) FILTER (prob >= 0.5 AND Label = 1) AS DOUBLE) AS tp,
                CAST(count(*) FILTER (prob >= 0.5 AND Label = 0) AS DOUBLE) AS fp,
                CAST(count(*) FILTER (prob < 0.5 AND Label = 1) AS DOUBLE) AS fn,
                CAST(count(*) FILTER (prob < 0.5 AND Label = 0) AS DOUBLE) AS tn FROM scored)""",
        "node_roc_auc": """
            SELECT round((sum(place) FILTER (y = 1) - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM (
                SELECT y, rank() OVER (ORDER BY out_ct) + (count(*) OVER (PARTITION BY out_ct) - 1) / 2.0 AS place,
                    CAST(count(*) FILTER (y = 1) OVER () AS DOUBLE) AS p, CAST(count(*) FILTER (y = 0) OVER () AS DOUBLE) AS n
                FROM (SELECT out_ct, y FROM stats JOIN (SELECT SensorId, node, max(LabelCNC) AS y FROM
                    (SELECT SensorId, SrcAddr AS node, LabelCNC FROM scored
                    UNION ALL SELECT SensorId, DstAddr, LabelCNC FROM scored) GROUP BY 1, 2) USING (SensorId, node)))
            GROUP BY p, n""",
        "regression_metrics": f"SELECT {_six('MSE', 'RMSE', 'MAE', 'R2')} FROM ({_regression})",
        "metrics_log": f"SELECT Model, {_six('MSE', 'RMSE', 'MAE', 'R2')} FROM ({_regression})"
        " CROSS JOIN (VALUES ('first'), ('second')) v(Model)",
        "export_order": "SELECT SensorId, count(*) AS nodes, true AS ordered FROM nodes GROUP BY 1",
        "edge_state": "SELECT SensorId, SrcAddr, DstAddr, w_sensor, w_global, w_sensor AS n_prob, sum_prob FROM edges",
        "peer_estimates": "SELECT SensorId, node, out_unique_dests, in_unique_srcs FROM stats",
        "approximate_cutoffs": "SELECT SensorId, count(*) AS nodes, true AS within FROM nodes GROUP BY 1",
        "score_histogram": "SELECT CAST(least(floor(prob * 1000), 999) AS INTEGER) AS bin, count(*) FILTER (Label = 1) AS pos,"
        " count(*) FILTER (Label = 0) AS neg FROM scored GROUP BY 1",
        "header_line_numbers": """
            SELECT SensorId, line FROM (
                SELECT SensorId, Sport, row_number() OVER (PARTITION BY SensorId ORDER BY Sport) AS line FROM flows)
            WHERE Sport % 50 = 0""",
        "ingest_report": _ingest_report(),
        "type_report": _type_report(),
        "stack_check": _checked,
        "forest_check": _checked,
        "node_export": "SELECT SensorId, node, in_ct, out_ct, round(cnc_score, 6) AS cnc_score FROM nodes",
    }
    found["split_export"] = found["split_counts"]
    drawn_matrix = f"""
        SELECT SensorId, SrcAddr, DstAddr, Label, LabelCNC, {', '.join(FEATURES)}, CASE WHEN place <= flows THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY {_draw('text')}) AS place FROM matrix)
        JOIN (SELECT Label AS of, flows FROM ({found['split_counts']}) WHERE split = 'train') ON Label = of"""
    found["feature_vector"] = " UNION ALL ".join(
        f"SELECT {i} AS pos, count(*) AS flows, max({f}) AS max_value FROM matrix" for i, f in enumerate(FEATURES)
    )
    result = {name: _sql(text) for name, text in found.items()}
    result["split"] = _sql(drawn_matrix, {
        "scored": TABLES["scored"].replace("SELECT *,", f"SELECT *, {FLOW_TEXT} AS text,"),
        "matrix": TABLES["matrix"].replace("LabelCNC, ", "LabelCNC, text, "),
    })
    result["random_subgraph"] = _sql("SELECT SensorId, src, dst, weight FROM drawn_edges WHERE place <= 400", RANDOM_GRAPH)
    result["schema_table"] = (
        'SELECT column_name AS "Column", column_type AS "Type" FROM (DESCRIBE ' + TABLES["flows"] + ")"
    )
    wide, tight = _kept(500, 800), _kept(100, 200)
    result["subgraph_nodes"] = _sql(GRAPH_NODES.format(score=", round(r.cnc_score, 6) AS cnc_score"), wide)
    result["subgraph_edges"] = _sql("SELECT * FROM kept_edges", wide)
    result["tight_subgraph_nodes"] = _sql(GRAPH_NODES.format(score=""), tight)
    result["tight_subgraph_edges"] = _sql("SELECT * FROM kept_edges", tight)
    every = _host_names()
    counts = [n for n in every if n.endswith("_count")]
    inexact = [n for n in every if n not in counts]
    result["node_features"] = _sql(f"SELECT SensorId, node, {', '.join(counts)}, {_single(inexact)} FROM hosts", HOSTS)
    result["neighbour_mean"] = _sql(f"SELECT SensorId, node, {_single(every)} FROM ({_means(every, 'hosts')})", HOSTS)
    hops = {**HOSTS, "hop1": _means(every, "hosts"), "hop2": _means(every, "hop1")}
    both = ", ".join(f"CAST(CAST({h}.{c} AS FLOAT) AS DOUBLE) AS {h}_{c}" for h in ("hop1", "hop2") for c in every)
    result["two_hop_mean"] = _sql(f"SELECT SensorId, node, {both} FROM hop1 JOIN hop2 USING (SensorId, node)", hops)
    result["quality_bounds"] = _sql(
        """
        SELECT round(sum(neg * (p - pos)) / (any_value(ps) * any_value(ns)), 6) AS auc_low,
            round(sum(neg * p) / (any_value(ps) * any_value(ns)), 6) AS auc_high,
            round(max(sqrt(p / ps * (1 - n / ns))), 6) AS balance_low,
            round(max(sqrt(p / ps * (1 - (n - neg) / ns))), 6) AS balance_high,
            round(arg_max(bin, (sqrt(p / ps * (1 - n / ns)), bin)) / 40.0, 6) AS threshold
        FROM summed""",
        {
            "binned": "SELECT least(floor(prob * 40), 39) AS bin, CAST(count(*) FILTER (Label = 1) AS DOUBLE) AS pos,"
            " CAST(count(*) FILTER (Label = 0) AS DOUBLE) AS neg FROM scored GROUP BY 1",
            "summed": "SELECT *, sum(pos) OVER (ORDER BY bin DESC) AS p, sum(neg) OVER (ORDER BY bin DESC) AS n,"
            " sum(pos) OVER () AS ps, sum(neg) OVER () AS ns FROM binned",
        },
    )
    result["roc_points"] = _sql(f"SELECT threshold, pos_upto, neg_upto, {_six('tpr', 'fpr')} FROM curve", ROC)
    result["best_threshold"] = _sql(
        "SELECT threshold, round(sqrt(tpr * (1 - fpr)), 6) AS balance FROM curve WHERE corner"
        " ORDER BY sqrt(tpr * (1 - fpr)) DESC, threshold DESC LIMIT 1", ROC,
    )
    result["roc_auc"] = _sql(
        "SELECT round(sum(neg * (pos_upto - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc FROM curve",
        ROC,
    )
    return result
