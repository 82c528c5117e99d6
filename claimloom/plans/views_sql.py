"""The stand-in views as ANSI SQL, for checking results with a second engine."""

VIEWS = {
    "cand": """
SELECT 'doc-'||(l_orderkey%10) AS document_id,
 concat_ws('-','li',l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity::INTEGER) AS candidate_id,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
 CASE l_returnflag WHEN 'R' THEN 'text' WHEN 'N' THEN 'table' ELSE 'scheme' END AS source,
 p_name||'/'||p_size AS r_label, p_type AS p_label,
 CASE l_linenumber WHEN 7 THEN 'own-'||p_type WHEN 6 THEN 'bad('||p_type END AS r_smiles,
 lower(regexp_replace(p_name||'/'||p_size,'\\s+','','g')) AS r_key,
 lower(regexp_replace(p_type,'\\s+','','g')) AS p_key,
 'reagent-'||(l_suppkey%5) AS reagent_a, l_linestatus AS reagent_b, 'solvent-'||(l_partkey%3) AS solvent,
 l_quantity AS temperature_c, l_linenumber||' h' AS time, round(l_tax*1000,1) AS yield_pct,
 'O'||l_orderkey AS evidence_id, round(1-4*l_discount,2) AS confidence
FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "struc": """
SELECT document_id, candidate_id, compound_label, smiles,
 lower(regexp_replace(compound_label,'\\s+','','g')) AS label_key,
 CASE WHEN smiles NOT LIKE 'bad(%' THEN upper(smiles) END AS canonical,
 CASE WHEN smiles NOT LIKE 'bad(%' AND smiles LIKE '%3' THEN 1 ELSE 0 END AS n_unspecified
FROM (
 SELECT DISTINCT 'doc-'||(l_orderkey%10) AS document_id, 's-'||p_partkey AS candidate_id,
  p_name||'/'||p_size AS compound_label,
  CASE WHEN p_size%10=0 THEN 'bad('||p_brand ELSE p_brand||'-'||p_type||'-'||p_size END AS smiles
 FROM lineitem JOIN part ON l_partkey=p_partkey
 UNION ALL
 SELECT DISTINCT 'doc-'||(l_orderkey%10), 't-'||p_type, p_type, p_type
 FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_orderkey%2=0)""",
    "lab": """
SELECT document_id, label_key, count(*) AS n_candidates, count(DISTINCT canonical) AS n_structures,
 min(canonical) AS one, sum(n_unspecified) AS n_open_stereo, min(candidate_id) AS some_candidate
FROM struc WHERE canonical IS NOT NULL AND label_key<>'' GROUP BY ALL""",
    "grp": """
SELECT document_id, r_key, p_key, count(*) AS n_candidates,
 first(candidate_id ORDER BY confidence DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS base_candidate,
 first(candidate_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS first_candidate,
 sum(confidence::DECIMAL(38,12))::DOUBLE/count(*) AS mean_confidence,
 count(DISTINCT source)>1 AS many_sources,
 count(DISTINCT temperature_c)>1 AS conflict_temperature_c, count(DISTINCT time)>1 AS conflict_time,
 count(DISTINCT yield_pct)>1 AS conflict_yield_pct,
 substr(sha256(document_id||chr(31)||r_key||chr(31)||p_key||chr(31)||'false'),1,32) AS group_id
FROM cand GROUP BY document_id, r_key, p_key""",
    "dig": """
SELECT document_id, r_key, p_key, count(*) AS n_evidence,
 bit_xor(('0x'||substr(sha256(evidence_id),1,15))::BIGINT) AS digest
FROM (SELECT DISTINCT document_id, r_key, p_key, evidence_id FROM cand) GROUP BY ALL""",
    "comp": """
SELECT g.group_id, g.document_id, 0 AS side, c.r_label AS label, c.r_smiles AS smiles, c.r_key AS label_key
FROM grp g JOIN cand c ON c.candidate_id=g.base_candidate
UNION ALL
SELECT g.group_id, g.document_id, 1, c.p_label, NULL, c.p_key FROM grp g JOIN cand c ON c.candidate_id=g.base_candidate""",
    "resolved": """
SELECT c.*, CASE WHEN c.smiles NOT LIKE 'bad(%' THEN 'own' WHEN l.n_structures=1 THEN 'label'
  WHEN l.n_structures>1 THEN 'ambiguous' ELSE 'missing' END AS state,
 CASE WHEN c.smiles NOT LIKE 'bad(%' THEN upper(c.smiles) WHEN l.n_structures=1 THEN l.one END AS resolved_smiles,
 CASE WHEN l.n_structures>1 THEN l.n_candidates ELSE 0 END AS label_errors
FROM comp c LEFT JOIN lab l ON l.document_id=c.document_id AND l.label_key=c.label_key""",
    "rec": """
SELECT g.document_id,
 'reaction-'||substr(sha256(g.group_id||chr(31)||d.n_evidence||chr(31)||d.digest),1,32) AS reaction_id,
 g.group_id, g.first_candidate, g.base_candidate, b.temperature_c, b.time, b.yield_pct, g.n_candidates, g.many_sources,
 o.n_compounds, o.n_resolved, d.n_evidence, o.errors AS error_count,
 g.conflict_temperature_c, g.conflict_time, g.conflict_yield_pct,
 floor(least(1.0::DOUBLE, s.score)*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE AS confidence,
 CASE WHEN o.errors>0 OR s.score<0.75 OR o.n_resolved<o.n_compounds THEN 'needs_review' ELSE 'accepted' END AS review_status
FROM grp g JOIN dig d ON d.document_id=g.document_id AND d.r_key=g.r_key AND d.p_key=g.p_key
JOIN cand b ON b.candidate_id=g.base_candidate
JOIN (SELECT group_id, count(*) AS n_compounds, count(*) FILTER (state IN ('own','label')) AS n_resolved,
  (count(*) FILTER (state='ambiguous') + sum(label_errors))::BIGINT AS errors FROM resolved GROUP BY group_id) o
 ON o.group_id=g.group_id,
LATERAL (SELECT 0.35::DOUBLE*g.mean_confidence + 0.25::DOUBLE*(o.n_resolved/o.n_compounds::DOUBLE)
  + 0.2::DOUBLE*(CASE WHEN g.many_sources THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
  + 0.2::DOUBLE*greatest(0.0::DOUBLE, 1.0::DOUBLE-o.errors/greatest(1.0::DOUBLE, o.n_compounds::DOUBLE+1.0::DOUBLE)) AS score) s""",
    "pred": """
SELECT 'doc-'||(o_custkey%10) AS document_id, o_orderkey AS ord, CASE WHEN o_orderkey%20=1 THEN 'x' ELSE 'r' END||o_orderkey AS reaction_id,
 CASE WHEN o_orderkey%20=1 THEN 'Z'||o_orderkey ELSE 'C'||o_custkey END AS r_label, o_orderpriority AS p_label,
 CASE o_orderkey%9 WHEN 0 THEN NULL WHEN 1 THEN 'bad(x' WHEN 2 THEN 'C'||(o_custkey%5)||'N@'
  WHEN 3 THEN '[13C'||(o_custkey%5)||'N+]' WHEN 4 THEN 'C'||(o_custkey%5)||'N.[Cl-]'
  WHEN 5 THEN 'XC'||(o_custkey%5)||'N' ELSE 'C'||(o_custkey%5)||'N' END AS r_smiles,
 CASE WHEN o_orderkey%2=1 THEN 'P-'||o_orderpriority END AS p_smiles,
 lower(CASE WHEN o_orderkey%20=1 THEN 'Z'||o_orderkey ELSE 'C'||o_custkey END)||chr(31)||lower(regexp_replace(o_orderpriority,'\\s+','','g')) AS key,
 round(o_totalprice%100,2) AS yield_pct, o_orderstatus AS profile
FROM orders""",
    "gold": """
SELECT 'doc-'||(o_custkey%10) AS document_id, o_orderkey*2+copy AS ord,
 CASE o_orderkey%5 WHEN 0 THEN 'a' WHEN 1 THEN 'g' ELSE 'r' END||o_orderkey AS reaction_id,
 CASE WHEN o_orderkey%5=0 THEN 'Y'||o_orderkey ELSE 'C'||o_custkey END AS r_label, o_orderpriority AS p_label,
 CASE WHEN o_orderkey%11<>0 THEN 'C'||(o_custkey%5)||'N' END AS r_smiles,
 CASE WHEN o_orderkey%2=1 THEN 'P-'||o_orderpriority END AS p_smiles,
 lower(CASE WHEN o_orderkey%5=0 THEN 'Y'||o_orderkey ELSE 'C'||o_custkey END)||chr(31)||lower(regexp_replace(o_orderpriority,'\\s+','','g')) AS key,
 round(round(o_totalprice%100,2)+CASE o_orderkey%3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 3.0 END,2) AS yield_pct,
 o_orderstatus AS profile
FROM orders JOIN (SELECT 0 AS copy UNION ALL SELECT 1) ON copy=0 OR o_orderkey%5=2""",
    "mat": """
SELECT document_id, p_ord, g_ord, reaction_id, gold_reaction_id, basis FROM (
 SELECT p.document_id, p.ord AS p_ord, g.g_ord, p.reaction_id, p.reaction_id AS gold_reaction_id, 'id' AS basis
 FROM pred p JOIN (SELECT document_id, reaction_id, min(ord) AS g_ord FROM gold GROUP BY ALL) g
  ON g.document_id=p.document_id AND g.reaction_id=p.reaction_id
 UNION ALL
 SELECT a.document_id, a.ord, b.ord, a.reaction_id, b.reaction_id, 'key' FROM
  (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY ord) AS rn FROM pred
   WHERE (document_id, reaction_id) NOT IN (SELECT (document_id, reaction_id) FROM gold)) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY ord) AS rn FROM gold
   WHERE (document_id, reaction_id) NOT IN (SELECT (document_id, reaction_id) FROM pred)) b
  ON a.document_id=b.document_id AND a.key=b.key AND a.rn=b.rn)""",
    "ali": """
SELECT document_id, reaction_id, gold_reaction_id, alignment, alignment_basis, p_ord, g_ord FROM (
 WITH gg AS (SELECT *, count(*) OVER (PARTITION BY document_id, reaction_id) AS same,
   row_number() OVER (PARTITION BY document_id, reaction_id ORDER BY ord) AS nth FROM gold),
  hit AS (SELECT g.*, p.ord AS pid FROM gg g LEFT JOIN pred p ON p.document_id=g.document_id AND p.reaction_id=g.reaction_id),
  free AS (SELECT * FROM pred WHERE (document_id, reaction_id) NOT IN (SELECT (document_id, reaction_id) FROM gold)),
  opt AS (SELECT document_id, key, count(*) AS n, min(ord) AS oord, min_by(reaction_id, ord) AS oid FROM free GROUP BY ALL),
  opn AS (SELECT h.*, row_number() OVER (PARTITION BY h.document_id, h.key ORDER BY h.ord) AS knth, o.n, o.oord, o.oid
   FROM hit h LEFT JOIN opt o ON o.document_id=h.document_id AND o.key=h.key WHERE same=1 AND pid IS NULL)
 SELECT document_id, CASE WHEN nth=1 AND pid IS NOT NULL THEN reaction_id ELSE '<gold:'||reaction_id||'>' END AS reaction_id,
  reaction_id AS gold_reaction_id, CASE WHEN nth=1 AND pid IS NOT NULL THEN 'ambiguous' ELSE 'unmatched_gold' END AS alignment,
  'duplicate gold reaction_id '''||reaction_id||''' ('||same||' occurrences)' AS alignment_basis,
  CASE WHEN nth=1 THEN pid END AS p_ord, ord AS g_ord FROM hit WHERE same>1
 UNION ALL
 SELECT document_id, reaction_id, reaction_id, 'explicit_id', 'reaction_id equality', pid, ord FROM hit WHERE same=1 AND pid IS NOT NULL
 UNION ALL
 SELECT document_id, CASE WHEN n=1 AND knth=1 THEN oid ELSE '<gold:'||reaction_id||'>' END, reaction_id,
  CASE WHEN n=1 AND knth=1 THEN 'mapped' WHEN n>1 THEN 'ambiguous' ELSE 'unmatched_gold' END,
  CASE WHEN n=1 AND knth=1 THEN 'reaction_key match' WHEN n>1 THEN 'multiple candidates ('||n||') for reaction_key' ELSE 'no candidate found' END,
  CASE WHEN n=1 AND knth=1 THEN oord END, ord FROM opn
 UNION ALL
 SELECT f.document_id, f.reaction_id, NULL, 'unmatched_extracted', 'no gold match', f.ord, NULL FROM free f
  WHERE NOT EXISTS (SELECT 1 FROM opn o WHERE o.n=1 AND o.knth=1 AND o.document_id=f.document_id AND o.oord=f.ord))""",
    "dec": """
SELECT *, CASE WHEN target_kind IN ('reaction','completeness') THEN reaction_id ELSE reaction_id||':'||(ord%3) END AS target_id,
 CASE WHEN conclusion IN ('pending','not_applicable','insufficient_evidence') THEN 'r' END AS reason FROM (
 SELECT 'doc-'||(user_id%10) AS document_id, event_id AS ord, 'd'||event_id AS decision_id, 'r'||user_id AS reaction_id, user_id,
  CASE event_type WHEN 'click' THEN 'condition' WHEN 'view' THEN 'participant_identity' WHEN 'purchase' THEN CASE WHEN user_id%4=0 THEN 'completeness' ELSE 'reaction' END
   WHEN 'signup' THEN 'completeness' ELSE 'stereo' END AS target_kind,
  CASE WHEN event_id%397=0 THEN 'rejected' WHEN event_id%31=0 THEN 'pending' WHEN event_id%37=0 THEN 'insufficient_evidence'
   WHEN event_id%7=0 THEN 'not_applicable' ELSE 'confirmed' END AS conclusion,
  'u'||(user_id%3) AS reviewer, 'h'||(user_id//2)||'-'||CASE WHEN event_id%5=0 THEN 1 ELSE 0 END AS record_hash
 FROM events)""",
    "evid": """
SELECT 'doc-'||(o_orderkey%10) AS document_id, CASE WHEN o_orderkey%50=0 THEN 'Q' ELSE 'O' END||o_orderkey AS evidence_id, (o_orderkey%20)::INTEGER AS page, o_orderpriority AS text
FROM orders""",
    "paged": """
SELECT 'conv-'||conv_id||'-'||(turn//100) AS document_id, string_agg('## Page '||(turn+1)||chr(10)||text, chr(10) ORDER BY turn) AS markdown
FROM conversations GROUP BY conv_id, turn//100""",
    "tabled": """
SELECT 'b'||(p_partkey//1000)||'-'||p_brand AS document_id,
 'Brand '||p_brand||chr(10)||'| key | name |'||chr(10)||CASE WHEN p_brand<>'Brand#3' THEN '|---|---|'||chr(10) ELSE '' END
 ||string_agg('| '||p_partkey||' | '||p_name||' |', chr(10) ORDER BY p_partkey)
 ||chr(10)||'plain line'||chr(10)||'| lone | row |'||chr(10)||'end' AS markdown
FROM part GROUP BY p_partkey//1000, p_brand""",
    "rcd": """
SELECT *, CASE WHEN k%13=0 THEN 'rejected' WHEN k%3=0 OR k%7=0 THEN 'needs_review' ELSE 'accepted' END AS review_status FROM (
SELECT o_orderkey AS k, 'doc-'||(o_orderkey%10) AS document_id, 'r'||o_orderkey AS reaction_id, 'L'||(o_orderkey%50) AS r_label,
 CASE WHEN o_orderkey%3=0 THEN NULL WHEN o_orderkey%7=0 THEN 'bad(z' ELSE 'c'||(o_orderkey%5) END AS r_smiles,
 'N'||(o_orderkey%4) AS r2_name, 'P'||(o_orderkey%20) AS p_label,
 CASE WHEN o_orderkey%2=0 THEN 'rg'||(o_orderkey%4) END AS reagent, 'sv'||(o_orderkey%3) AS solvent,
 CASE WHEN o_orderkey%4<>0 THEN (o_orderkey%90)::DOUBLE END AS temperature_c, CASE WHEN o_orderkey%5<>0 THEN (o_orderkey%6)||' h' END AS time,
 CASE WHEN o_orderkey%11<>0 THEN (o_orderkey%100)::DOUBLE END AS yield_pct, round((o_orderkey%100)/100.0,2)::DOUBLE AS confidence,
 'O'||o_orderkey AS e1, 'O'||(o_orderkey+10) AS e2, o_orderkey%3=0 AS has_warning, o_orderkey%7=0 AS has_error FROM orders)""",
    "tsk": """
SELECT 'doc-'||(l_orderkey%10) AS document_id, concat_ws('-','t',l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity::INTEGER) AS task_id,
 CASE l_linenumber%3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'structure' END AS kind, 'O'||l_orderkey AS evidence_id, l_suppkey AS supplier,
 l_linestatus AS flag, l_suppkey%2=0 AS fulfilled FROM lineitem""",
    "hst": """
SELECT document_id, reaction_id, CASE WHEN rejected THEN 'rejected' WHEN n_open>0 THEN 'pending' WHEN n_ok>=n_seen+2 THEN 'confirmed' ELSE 'in_review' END AS human_status
FROM (SELECT document_id, reaction_id, bool_or(rej) AS rejected,
 count(*) FILTER (need AND conclusion IN ('pending','insufficient_evidence')) AS n_open,
 count(*) FILTER (need AND conclusion IN ('confirmed','not_applicable','revised')) AS n_ok, count(*) FILTER (seen) AS n_seen
 FROM (SELECT document_id, reaction_id, target_kind, target_id, max_by(conclusion, ord) AS conclusion, bool_or(conclusion='rejected') AS rej,
  target_kind IN ('condition','participant_identity','participant_structure','stereo') AS seen,
  target_kind IN ('condition','participant_identity','participant_structure','stereo') OR (target_kind IN ('reaction','completeness') AND target_id=reaction_id) AS need
  FROM dec GROUP BY ALL) GROUP BY ALL)""",
}

NEEDS = {
    "hst": ["dec"],
    "lab": ["struc"], "grp": ["cand"], "dig": ["cand"], "comp": ["grp"], "resolved": ["comp", "lab"],
    "rec": ["grp", "dig", "resolved"], "mat": ["pred", "gold"], "ali": ["pred", "gold"],
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the named views and what they need."""
    order: list[str] = []

    def visit(name):
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order) + "\n" + body.strip()
