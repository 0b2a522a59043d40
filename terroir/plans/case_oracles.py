"""SQL of the queries of ``cases``, written independently of their plans."""

from __future__ import annotations

FAR = "round({}, 6) NULLS LAST, numero_dpe NULLS FIRST, etiquette_dpe NULLS FIRST, surface_c NULLS FIRST, lat_c NULLS FIRST, lon_c NULLS FIRST"
CASE = "code, adresse, lat, lon, surface, kind"


def case_sql(link: str, on: str, far: str, evaluated: str, box: str, m: str, i: str, f: str, counts: str, inside: str, stat: str) -> dict[str, str]:
    u = f"""{link}, u AS (SELECT j.* FROM j JOIN o ON {on} WHERE o.match_status = 'ambigu' AND j.retenu),
        q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CASE} ORDER BY {FAR.format(far)}) - 1 AS pos FROM u) WHERE pos < 8)"""
    pair = "{'i': trim(coalesce(numero_dpe, '')), 'a': trim(coalesce(adresse_c, ''))}"
    run = f"""{evaluated}, run AS (SELECT motif, CASE WHEN h % 3 = 0 THEN 'cache' ELSE 'demande' END AS source, h % 7 AS input_tokens, h % 11 AS duree_ms
        FROM (SELECT motif, ('0x' || substr(md5(numero_dpe), 1, 4))::INT AS h FROM ev))"""
    labels = "ABCDEFG"
    return {
        "filter_p2_project_raw": "SELECT DISTINCT date_mutation::VARCHAR AS date_mutation, code_insee, identifiant_document, no_disposition, nature_mutation, 'B' AS btq, adresse_brute AS adresse, code_postal, commune, type_local FROM dvf_clean",
        "filter_p13_perimeter": "SELECT DISTINCT nom_commune_ban AS nom, code_insee_ban AS code_insee, substr(code_insee_ban, 1, 2) AS departement FROM dpe_clean WHERE nom_commune_ban IS NOT NULL AND code_insee_ban LIKE '96%'",
        "filter_p14_town_choices": """SELECT nom_commune_ban AS nom, code_insee_ban AS code_insee, replace(upper(strip_accents(nom_commune_ban)), '''', ' ') AS dvf_nom
            FROM (SELECT DISTINCT nom_commune_ban, code_insee_ban FROM dpe_clean WHERE nom_commune_ban IS NOT NULL AND code_insee_ban IS NOT NULL)""",
        "fn_f13_pool_fingerprint": f"WITH {u} SELECT code, adresse, surface, lat, sha256(to_json(list(s ORDER BY s))) AS empreinte FROM (SELECT {CASE}, {pair} AS s FROM q) GROUP BY {CASE}",
        "fn_f15_reference": f"WITH {u} SELECT 'c' || pos AS ref, count(*) AS n FROM q GROUP BY 1",
        "fn_f16_resource_year": r"SELECT DISTINCT fichier_id, nullif(regexp_extract(nom_fichier || ' ' || year(recu_le), '20\d{2}'), '')::INT AS annee FROM dvf_fichiers",
        "fn_f17_signed_percent": """SELECT DISTINCT edition, commune, annee, type_local, CASE WHEN p >= 0 THEN '+' ELSE '−' END || abs(p)::INT || ' %' AS ecart
            FROM (SELECT *, round((moyenne / mediane - 1) * 100) AS p FROM agg_marche WHERE moyenne IS NOT NULL AND mediane > 0)""",
        "fn_f18_window_label": "SELECT DISTINCT annee, CASE 2025 - annee::INT WHEN 1 THEN '1 an' WHEN 5 THEN '5 ans' ELSE 'depuis ' || annee END AS libelle FROM agg_marche WHERE annee IS NOT NULL",
        "fn_f19_start_year": "SELECT DISTINCT annee, greatest(annee, '2021') AS debut FROM agg_marche",
        "fn_f22_coordinates": f"WITH {box} SELECT code_iris, len(flatten(rings))::INT AS n, flatten(rings)[1] AS premier, flatten(rings)[-1] AS dernier FROM pts",
        "agg_a23_lots_by_town": "SELECT commune, count(*) AS n FROM dvf_clean WHERE coalesce(prix, 0) <> 0 AND coalesce(surface, 0) <> 0 GROUP BY 1 ORDER BY 2 DESC, 1",
        "agg_a24_years": "SELECT (SELECT list(DISTINCT annee ORDER BY annee) FROM agg_marche WHERE annee IS NOT NULL) AS annees, min(date_mutation) AS date_min, max(date_mutation) AS date_max, ['A-C', 'D', 'E', 'F-G'] AS groupes FROM dvf_dpe_matched",
        "agg_a26_run": f"""WITH {run} SELECT count(*) AS cas, count(*) FILTER (source = 'demande') AS appels, count(*) FILTER (source = 'cache') AS servis_par_cache,
            coalesce(sum(input_tokens) FILTER (source = 'demande'), 0)::BIGINT AS input_tokens, coalesce(sum(duree_ms) FILTER (source = 'demande'), 0) / 1000 AS duree_s FROM run""",
        "agg_a26_reasons": f"WITH {run} SELECT 'status' AS genre, source AS valeur, count(*) AS n FROM run GROUP BY source UNION ALL SELECT 'motif', motif, count(*) FROM run GROUP BY motif",
        "sort_o4_top_candidates": f"WITH {u} SELECT code, adresse, lat, lon, surface, kind, pos, numero_dpe FROM q",
        "sort_o8_towns": """WITH a AS (SELECT * FROM agg_marche WHERE edition = 1), g AS (SELECT * FROM (SELECT DISTINCT commune FROM a), (VALUES ('Appartement'), ('Maison')) t(type_local))
            SELECT g.commune, g.type_local, round(CASE WHEN b.moyenne <> 0 THEN c.moyenne / b.moyenne - 1 END, 4) AS evolution, coalesce(c.n, 0) AS n
            FROM g LEFT JOIN a c ON c.commune = g.commune AND c.type_local = g.type_local AND c.annee = '2024' LEFT JOIN a b ON b.commune = g.commune AND b.type_local = g.type_local AND b.annee = '2019' ORDER BY 3 DESC NULLS LAST, 1, 2""",
        "cube_m10_series": "SELECT commune, type_local, min(annee) AS annee_debut, coalesce(arg_min(n, annee), 0) AS n_debut, coalesce(max(n) FILTER (annee = '2025'), 0) AS n_fin, count(*)::INT AS annees, round(arg_max(moyenne, annee), 4) AS dernier_prix FROM agg_marche WHERE edition = 0 GROUP BY 1, 2",
        "cube_m10_evolutions": """WITH s AS (SELECT commune, type_local, annee, moyenne AS prix FROM agg_marche WHERE edition = 0),
            w AS (SELECT DISTINCT commune, type_local, f FROM s, (VALUES (1), (5)) t(f) UNION ALL SELECT commune, type_local, 2025 - min(annee)::INT FROM s GROUP BY 1, 2 HAVING 2025 - min(annee)::INT > 5),
            j AS (SELECT w.*, a.prix AS p0, b.prix AS p1, CASE WHEN b.prix IS NULL THEN 'annee de fin absente' WHEN a.prix IS NULL THEN 'annee de depart absente' WHEN a.prix = 0 THEN 'prix de depart nul' END AS raison
                  FROM w LEFT JOIN s a ON a.commune = w.commune AND a.type_local = w.type_local AND a.annee = (2025 - f)::VARCHAR LEFT JOIN s b ON b.commune = w.commune AND b.type_local = w.type_local AND b.annee = '2025')
            SELECT commune, type_local, f::INT AS fenetre_ans, CASE WHEN raison IS NOT NULL THEN f || ' ans' WHEN f = 1 THEN '1 an' WHEN f = 5 THEN '5 ans' ELSE 'depuis ' || (2025 - f) END AS libelle,
                   round(p0, 4) AS prix_debut, round(p1, 4) AS prix_fin, raison, raison IS NULL AS calculee FROM j""",
        "cube_m10_labels": f"""{m}, a AS (SELECT commune, type_local, etiquette_dpe, count(*) AS n, avg(prix_m2) AS pm2 FROM p WHERE {inside} GROUP BY ALL),
            t AS (SELECT commune, type_local, {', '.join(f"coalesce(max(n) FILTER (etiquette_dpe = '{x}'), 0) AS n_{x}" for x in labels)}, max(pm2) FILTER (etiquette_dpe = 'D') AS d FROM a GROUP BY 1, 2)
            SELECT commune, type_local, [{', '.join(f'n_{x}' for x in labels)}] AS n, CASE WHEN d <> 0 THEN (n_F > 0)::BIGINT + (n_G > 0)::BIGINT ELSE 0 END AS n_ecarts FROM t""",
        "cube_m13_global": f"{f} SELECT type_local, annee, {stat} FROM p WHERE type_local = 'Maison' AND annee BETWEEN '2018' AND '2023' GROUP BY ALL",
        "cube_m13_town": "SELECT annee, n, moyenne, mediane FROM agg_marche WHERE edition = 1 AND commune = 'Vaumirac' AND type_local = 'Appartement' AND annee BETWEEN '2018' AND '2023' ORDER BY annee",
        "cube_m13_counts": f"""{m}, {counts}, v(t, g) AS (VALUES (NULL, NULL), ('Maison', NULL), ('Maison', 'D'), (NULL, 'absent'))
            SELECT t::VARCHAR AS type_local, g::VARCHAR AS groupe, coalesce(sum(retenues), 0)::BIGINT AS retenues, coalesce(sum(resolu_consensus), 0)::BIGINT AS resolu_consensus, coalesce(sum(pre_reforme_exclus), 0)::BIGINT AS pre_reforme_exclus
            FROM v LEFT JOIN counts ON type_local IS NOT DISTINCT FROM t AND groupe IS NOT DISTINCT FROM g AND commune = 'Vaumirac' AND annee BETWEEN '2019' AND '2024' GROUP BY t, g""",
        "cube_m13_ladder": f"""{m}, k AS (SELECT * FROM p WHERE {inside}) SELECT 'ensemble' AS niveau, NULL AS commune, etiquette_dpe, type_local, {stat} FROM k WHERE type_local = 'Maison' GROUP BY etiquette_dpe, type_local
            UNION ALL SELECT 'commune', commune, etiquette_dpe, type_local, {stat} FROM k WHERE type_local = 'Appartement' AND commune = 'Vaumirac' GROUP BY commune, etiquette_dpe, type_local""",
        "cube_m13_iris": f"{i} SELECT code_iris, nom_iris, count(*) AS n, round(avg(prix_m2), 4) AS valeur FROM p WHERE code_iris IS NOT NULL AND type_local = 'Appartement' AND annee BETWEEN '2018' AND '2022' GROUP BY 1, 2",
        "site_m11_parts": f"""{m}, {counts} SELECT 'meta' AS partie, 1::BIGINT AS n UNION ALL SELECT 'meta.appariement', 5 UNION ALL SELECT 'marche.communes', count(*) FROM agg_marche UNION ALL SELECT 'impact.comptages', count(*) FROM counts
            UNION ALL SELECT 'communes.appariement', count(*) FROM (SELECT DISTINCT commune, match_status FROM dvf_dpe_matched) UNION ALL SELECT 'iris.geojson', count(*) FROM iris_polygones""",
        "score_d1_states": f"WITH {u} SELECT code, adresse, surface, lat, to_json({{'mutation': trim(adresse), 'candidats': list({{'ref': 'c' || pos, 'adresse': trim(coalesce(adresse_c, ''))}} ORDER BY pos)}})::VARCHAR AS etat FROM q GROUP BY {CASE}",
        "score_d2_questions": f"WITH {u} SELECT code, 'c' || pos AS ref, 'score' AS type, count(*) AS n FROM q GROUP BY 1, 2 UNION ALL SELECT code, 'garde', 'noul', count(*) FROM (SELECT DISTINCT {CASE} FROM q) GROUP BY 1",
        "score_d5_responses": "SELECT doc_id, n_cells / 4 AS score, 0.5::DOUBLE AS confiance, 'm1' AS modele, coalesce(n_chars, 0)::BIGINT AS input_tokens FROM documents",
        "score_d7_cases": f"""WITH {u}, cs AS (SELECT code, trim(adresse) AS adresse, to_json(list(s ORDER BY s))::VARCHAR AS pool, count(*) AS k FROM (SELECT {CASE}, {pair} AS s FROM q) GROUP BY {CASE})
            SELECT count(*) AS cas, count(DISTINCT (code, adresse, pool)) AS cles, sum(k)::BIGINT AS candidats FROM cs""",
    }
