"""Queries of the training-data problems and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from peakloom.functions.keys import SPACE, record_key_sql, structure_key_sql
from peakloom.llm import capping, languages, leaks, mixing, neighbours, overlaps, splits, survivors
from peakloom.session import table


def queries():
    t = table
    train = lambda s, d: t(s, d, "train_spectra")
    test = lambda s, d: t(s, d, "test_spectra")
    structs = lambda s, d: t(s, d, "train_structs")
    docs = lambda s, d: t(s, d, "documents")
    return {
        "p1_found": lambda s, d: splits.moved_records(train(s, d), structs(s, d)),
        "p1_splits": lambda s, d: splits.assign_splits(train(s, d), structs(s, d), t(s, d, "split_targets")),
        "p2_found": lambda s, d: overlaps.matches(train(s, d), test(s, d)).select("rid", "spectrum_id"),
        "p2_report": lambda s, d: overlaps.overlap_report(overlaps.matches(train(s, d), test(s, d)), train(s, d), test(s, d)),
        "p3_found": lambda s, d: neighbours.similar_structures(structs(s, d)),
        "p3_structures": lambda s, d: neighbours.nearest(neighbours.usable(structs(s, d)).select("sid", "fp"), "sid", "fp").withColumnRenamed("id", "sid"),
        "p3_spectra": lambda s, d: neighbours.similar_spectra(train(s, d)),
        "p4_found": lambda s, d: survivors.survivors(t(s, d, "pubchem_rows")).select("ik", "cid", "smiles_cid", "mass_cid"),
        "p4_survivors": lambda s, d: survivors.survivors(t(s, d, "pubchem_rows")).select("ik", "cid", "smiles", "mass", "n_rows"),
        "p6_found": lambda s, d: capping.dropped(train(s, d)),
        "p6_capped": lambda s, d: capping.cap_records(train(s, d)).select("rid", "lib", "group_key", "kept"),
        "p7_found": lambda s, d: leaks.leaks(docs(s, d), t(s, d, "eval_items")).select("doc_id", "item_id"),
        "p8_mix": lambda s, d: mixing.mix(docs(s, d), t(s, d, "mix_targets"))[0],
        "p8_shares": lambda s, d: mixing.mix(docs(s, d), t(s, d, "mix_targets"))[1],
        "p9_found": lambda s, d: languages.document_languages(docs(s, d)).where("not right").select("doc_id", "lang"),
        "p9_stretches": lambda s, d: languages.identify(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    lib = f"lower(regexp_replace(ingest_lib, '^{SPACE}|{SPACE}$', '', 'g'))"
    score = "CASE WHEN quality_score >= 0 AND quality_score <= 1 AND NOT isnan(quality_score) THEN quality_score END"
    capped = f"""SELECT rid, lib, group_key, row_number() OVER (PARTITION BY lib, group_key ORDER BY score DESC NULLS LAST, rid) <= {capping.CAP} AS kept
        FROM (SELECT rid, {lib} AS lib, {record_key_sql()} AS group_key, {score} AS score FROM train_spectra) WHERE lib IS NOT NULL AND group_key IS NOT NULL"""
    nothing = ", ".join(f"'{x}'" for x in survivors.NOTHING)
    ranked = f"""WITH r AS (SELECT {structure_key_sql("ik")} AS k, *, NOT coalesce(lower(regexp_replace(smiles, '^{SPACE}|{SPACE}$', '', 'g')), '') IN ({nothing}) AS ok_s,
            coalesce(mass > 0 AND mass < {survivors.MASS_MAX}, false) AS ok_m FROM pubchem_rows),
        o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY trust DESC NULLS LAST, updated_at DESC NULLS LAST, cid NULLS LAST, smiles NULLS LAST, mass NULLS LAST) AS rn FROM r WHERE k IS NOT NULL)
        SELECT k AS ik, coalesce(arg_min(cid, rn) FILTER (WHERE ok_s AND ok_m), arg_min(cid, rn)) AS cid, """
    tail = " FROM o GROUP BY k HAVING count(DISTINCT cid) > 1"
    ends = f"""WITH RECURSIVE s AS (SELECT {structure_key_sql("inchikey14")} AS u, min({structure_key_sql("key")}) AS v FROM train_structs WHERE {structure_key_sql("key")} <> {structure_key_sql("inchikey14")} GROUP BY 1),
        walk AS (SELECT u AS key, v AS place, 1 AS depth FROM s UNION ALL SELECT w.key, s.v, w.depth + 1 FROM walk w JOIN s ON s.u = w.place WHERE w.depth < 1000),
        ends AS (SELECT key, arg_max(place, depth) AS group_key FROM walk GROUP BY key),
        r AS (SELECT rid, inchikey14, {record_key_sql()} AS key FROM train_spectra)
        SELECT rid, coalesce(e.group_key, r.key) AS group_key FROM r LEFT JOIN ends e USING (key) WHERE r.key IS NOT NULL AND r.inchikey14 IS DISTINCT FROM coalesce(e.group_key, r.key)"""
    return {
        "p1_found": ends,
        "p4_found": f"{ranked} arg_min(cid, rn) FILTER (WHERE ok_s) AS smiles_cid, arg_min(cid, rn) FILTER (WHERE ok_m) AS mass_cid {tail}",
        "p4_survivors": f"{ranked} arg_min(smiles, rn) FILTER (WHERE ok_s) AS smiles, arg_min(mass, rn) FILTER (WHERE ok_m) AS mass, count(*) AS n_rows {tail}",
        "p6_found": f"SELECT rid FROM ({capped}) WHERE NOT kept",
        "p6_capped": capped,
    }
