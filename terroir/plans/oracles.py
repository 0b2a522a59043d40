"""For each query, the same result in ANSI SQL over the same tables, written independently of the DataFrame plans."""

from __future__ import annotations

from terroir.constants import CONFIDENCE_EDGES, DISTANCE_EDGES, MARGIN_EDGES
from terroir.functions.text import ABBREVIATIONS
from terroir.plans.case_oracles import FAR, case_sql

_HOME = "coalesce(type_local IN ('Appartement', 'Maison'), false)"
_KEYS = "date_mutation, code_insee, no_disposition, prix"


def _fold(source: str, ident: str, extra: tuple[str, ...] = (), carry: tuple[str, ...] = ("commune", "type_local")) -> str:
    """CTEs h, s and p: lots, sales with their reason, points."""
    same = " AND ".join(f"h.{k} IS NOT DISTINCT FROM s.{k}" for k in _KEYS.split(", "))
    keys = ", ".join(f"h.{k}" for k in _KEYS.split(", "))
    ex = "".join(f", h.{e}" for e in extra)
    rep = ", ".join(f"{c} := h.{c}" for c in carry)
    out = ", ".join(f"r.{c} AS {c}" for c in carry)
    return f"""
    h AS (SELECT *, {_HOME} AS home FROM {source}),
    s0 AS (SELECT {_KEYS}, count(*) FILTER (home) AS n_lots, sum(surface) FILTER (home) AS total, min(type_local) FILTER (home) AS k0, max(type_local) FILTER (home) AS k1,
             bool_or(NOT home AND type_local IS DISTINCT FROM 'Dépendance' AND coalesce(surface, 0) > 0) AS built,
             (arg_min({{'n': nature_mutation}}, {ident}) FILTER (home)).n AS nature FROM h GROUP BY ALL),
    s AS (SELECT *, CASE WHEN n_lots = 0 THEN 'sans_habitation' WHEN built OR k0 <> k1 THEN 'mixte'
             WHEN NOT coalesce(nature IN ('Vente', 'Vente en l''état futur d''achèvement', 'Adjudication'), false) THEN 'nature'
             WHEN prix IS NULL OR total IS NULL OR total = 0 THEN 'inexploitable'
             WHEN NOT (prix / total BETWEEN 200 AND 30000) THEN 'hors_bande' END AS motif FROM s0),
    p0 AS (SELECT {keys}{ex}, s.prix / s.total AS prix_m2, s.n_lots, arg_min(struct_pack({rep}), h.{ident}) AS r
             FROM h JOIN s ON {same} WHERE h.home AND s.motif IS NULL GROUP BY ALL),
    p AS (SELECT {_KEYS}{''.join(', ' + e for e in extra)}, prix_m2, n_lots, nullif(substr(date_mutation::VARCHAR, 1, 4), '') AS annee, {out} FROM p0)"""


_LOTS = _fold("dvf_iris", "lot_id")
_IRIS = _fold("dvf_iris", "lot_id", carry=("commune", "type_local", "code_iris", "nom_iris"))
_IMPACT = _fold("dvf_dpe_matched", "match_id", extra=("etiquette_dpe", "match_status"))
_SURE = "match_status IN ('trouve', 'resolu_consensus')"
_IN = f"{_SURE} AND coalesce(date_mutation, '') >= '2021-07-01'"
_GROUP = """CASE WHEN upper(regexp_replace(etiquette_dpe, '^\\s+|\\s+$', '', 'g')) IN ('A', 'B', 'C') THEN 'A-C' WHEN upper(regexp_replace(etiquette_dpe, '^\\s+|\\s+$', '', 'g')) = 'D' THEN 'D'
            WHEN upper(regexp_replace(etiquette_dpe, '^\\s+|\\s+$', '', 'g')) = 'E' THEN 'E' WHEN upper(regexp_replace(etiquette_dpe, '^\\s+|\\s+$', '', 'g')) IN ('F', 'G') THEN 'F-G' END"""
_STAT = "count(*) AS n, round(avg(prix_m2), 4) AS moyenne, round(median(prix_m2), 4) AS mediane"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _normal(x: str) -> str:
    out = f"trim(regexp_replace(upper(strip_accents(replace(coalesce({x}, ''), '’', ''''))), '\\s+', ' ', 'g'))"
    for short in sorted(ABBREVIATIONS, key=lambda s: (-len(s), s)):
        out = f"regexp_replace({out}, '\\b{short}\\b\\.?', '{ABBREVIATIONS[short]}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _any_of(*names: str) -> str:
    """The value of the first of some names that a line has, JSON null counting as none."""
    each = ", ".join(f"nullif(json_extract(contenu, '$.{n}')::VARCHAR, 'null')" for n in names)
    return f"coalesce({each})::JSON"


def _part(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _query_text(street: str, postcode: str, town: str, trim: bool = True) -> str:
    s = f"nullif(trim(regexp_replace(coalesce({street}, ''), '\\s+', ' ', 'g')), '')"
    p = _part(postcode) if trim else f"nullif({postcode}, '')"
    return f"CASE WHEN {s} IS NOT NULL THEN concat_ws(' ', {s}, {p}, {_part(town)}) END"


#: The linkage: certificates without duplicates, profiles, candidates of either pass, judged pools, outcomes.
_LINK = f"""
    d0 AS (SELECT *, trim(coalesce(adresse_normalisee, '')) AS a, trim(coalesce(code_insee_ban, '')) AS t, row_number() OVER (
             PARTITION BY trim(coalesce(code_insee_ban, '')), trim(coalesce(adresse_normalisee, '')), round(surface_habitable_logement, 1), etiquette_dpe, etiquette_ges, periode_construction, type_batiment
             ORDER BY coalesce(date_etablissement_dpe, '') DESC, coalesce(numero_dpe, '') DESC, lat DESC NULLS LAST, lon DESC NULLS LAST, surface_habitable_logement DESC NULLS LAST) AS rn FROM dpe_clean),
    d AS (SELECT * FROM d0 WHERE a = '' OR t = '' OR rn = 1),
    c AS (SELECT t AS code, adresse_normalisee AS adresse_c, lat AS lat_c, lon AS lon_c, surface_habitable_logement AS surface_c, numero_dpe, etiquette_dpe, etiquette_ges, type_batiment, periode_construction FROM d WHERE t <> ''),
    prof AS (SELECT DISTINCT trim(code_insee) AS code, coalesce(adresse_normalisee, '') AS adresse, lat, lon, surface, type_local AS kind FROM dvf_geocoded),
    ex AS (SELECT prof.*, c.* EXCLUDE (code), 'texte_exact' AS passe FROM prof JOIN c ON prof.code = c.code AND prof.adresse = c.adresse_c WHERE prof.adresse <> ''),
    rest AS (SELECT * FROM prof WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.code = prof.code AND c.adresse_c = prof.adresse AND c.adresse_c <> '')),
    nr_all AS (SELECT q.*, c.* EXCLUDE (code), 'distance' AS passe FROM prof q JOIN c ON q.code = c.code WHERE q.lat IS NOT NULL AND q.lon IS NOT NULL AND c.lat_c IS NOT NULL AND c.lon_c IS NOT NULL
             AND abs(c.lat_c - q.lat) <= 15.0 / 111320.0 AND abs(c.lon_c - q.lon) <= 15.0 / (111320.0 * abs(cos(radians(q.lat)))) AND {_hav('q.lat', 'q.lon', 'c.lat_c', 'c.lon_c')} <= 15.0),
    nr AS (SELECT n.* FROM nr_all n SEMI JOIN rest r ON n.code = r.code AND n.adresse = r.adresse AND n.lat IS NOT DISTINCT FROM r.lat AND n.lon IS NOT DISTINCT FROM r.lon AND n.surface IS NOT DISTINCT FROM r.surface AND n.kind IS NOT DISTINCT FROM r.kind),
    cand AS (SELECT * FROM ex UNION ALL SELECT * FROM nr),
    j0 AS (SELECT *, count(*) OVER w AS n, NOT coalesce((kind = 'Appartement' AND type_batiment = 'maison') OR (kind = 'Maison' AND type_batiment = 'appartement'), false) AS ok FROM cand WINDOW w AS (PARTITION BY code, adresse, lat, lon, surface, kind)),
    j1 AS (SELECT *, count(*) FILTER (ok) OVER w AS n_ok FROM j0 WINDOW w AS (PARTITION BY code, adresse, lat, lon, surface, kind)),
    j2 AS (SELECT *, n > 1 AND n_ok > 0 AND n_ok < n AS filtre FROM j1),
    j3 AS (SELECT *, NOT filtre OR ok AS garde, coalesce(abs(surface - surface_c) <= 2.0, false) AND (NOT filtre OR ok) AS dans FROM j2),
    j4 AS (SELECT *, count(*) FILTER (garde) OVER w AS m, count(*) FILTER (dans) OVER w AS nd FROM j3 WINDOW w AS (PARTITION BY code, adresse, lat, lon, surface, kind)),
    j AS (SELECT *, garde AND (dans OR nd = 0) AS retenu FROM j4),
    o0 AS (SELECT code, adresse, lat, lon, surface, kind, min(m) AS m, bool_or(filtre) AS filtre, min(passe) AS passe, count(*) FILTER (retenu) AS k,
             min(numero_dpe) FILTER (retenu) AS numero_dpe, {', '.join(f'min({x}) FILTER (retenu) AS v_{x}, count({x}) FILTER (retenu) = count(*) FILTER (retenu) AND min({x}) FILTER (retenu) = max({x}) FILTER (retenu) AS u_{x}' for x in ('etiquette_dpe', 'etiquette_ges', 'type_batiment', 'periode_construction'))}
             FROM j GROUP BY ALL),
    o AS (SELECT code, adresse, lat, lon, surface, kind, CASE WHEN m = 1 OR k = 1 THEN 'trouve' WHEN coalesce(u_etiquette_dpe, false) THEN 'resolu_consensus' ELSE 'ambigu' END AS match_status,
             CASE WHEN m = 1 THEN passe WHEN k = 1 THEN passe || '_surface' WHEN coalesce(u_etiquette_dpe, false) THEN 'consensus_etiquette' END AS match_methode, filtre AS filtre_type_applique,
             CASE WHEN m = 1 OR k = 1 THEN numero_dpe END AS numero_dpe, {', '.join(f'CASE WHEN m = 1 OR k = 1 THEN v_{x} WHEN coalesce(u_etiquette_dpe, false) AND u_{x} THEN v_{x} END AS {x}' for x in ('etiquette_dpe', 'etiquette_ges', 'type_batiment', 'periode_construction'))} FROM o0)"""


def _on(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in ("code", "adresse", "lat", "lon", "surface", "kind"))


_LINKED = f"""{_LINK},
    g AS (SELECT *, trim(code_insee) AS code, coalesce(adresse_normalisee, '') AS adresse, type_local AS kind FROM dvf_geocoded),
    linked AS (SELECT g.lot_id, g.date_mutation, coalesce(o.match_status, 'non_trouve') AS match_status, o.match_methode, coalesce(o.filtre_type_applique, false) AS filtre_type_applique, o.numero_dpe, o.etiquette_dpe, o.etiquette_ges, o.type_batiment, o.periode_construction
               FROM g LEFT JOIN o ON {_on('g', 'o')})"""

_PAIRS = f"""pairs AS (SELECT adresse, {_hav('lat', 'lon', 'lat_c', 'lon_c')} AS distance_m FROM (
    SELECT DISTINCT l.adresse_normalisee AS adresse, l.lat, l.lon, c.lat AS lat_c, c.lon AS lon_c FROM dvf_geocoded l JOIN dpe_clean c USING (adresse_normalisee)
    WHERE l.lat IS NOT NULL AND l.lon IS NOT NULL AND c.lat IS NOT NULL AND c.lon IS NOT NULL AND l.adresse_normalisee <> ''))"""

_BOX = """pts AS (SELECT code_iris, CASE WHEN json_extract_string(geometry, '$.type') = 'Polygon'
        THEN from_json(json_extract(geometry, '$.coordinates'), '[[["DOUBLE"]]]') ELSE flatten(from_json(json_extract(geometry, '$.coordinates'), '[[[["DOUBLE"]]]]')) END AS rings FROM iris_polygones),
    xy AS (SELECT code_iris, unnest(flatten(rings)) AS p FROM pts),
    box AS (SELECT code_iris, min(p[1]) AS ouest, min(p[2]) AS sud, max(p[1]) AS est, max(p[2]) AS nord FROM xy GROUP BY code_iris)"""

_PIP = """pl AS (SELECT code_iris, CASE WHEN json_extract_string(geometry, '$.type') = 'Polygon' THEN from_json(json_extract(geometry, '$.coordinates'), '[[["DOUBLE"]]]')
                     ELSE flatten(from_json(json_extract(geometry, '$.coordinates'), '[[[["DOUBLE"]]]]')) END AS rings FROM iris_polygones),
            rg AS (SELECT code_iris, unnest(rings) AS ring FROM pl),
            ed AS (SELECT code_iris, ring[k][1] AS x1, ring[k][2] AS y1, ring[k + 1][1] AS x2, ring[k + 1][2] AS y2 FROM (SELECT code_iris, ring, unnest(range(1, len(ring))) AS k FROM rg)),
            pt AS (SELECT DISTINCT lot_id, lat, lon, coalesce(code_iris, '') AS recorded FROM dvf_iris WHERE lat IS NOT NULL AND lon IS NOT NULL),
            hit AS (SELECT lot_id, lat, lon, e.code_iris AS code FROM pt JOIN ed e ON (e.y1 > lat) <> (e.y2 > lat) AND lon < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY lot_id, lat, lon, e.code_iris HAVING count(*) % 2 = 1),
            h1 AS (SELECT lot_id, lat, lon, min(code) AS code FROM hit GROUP BY ALL)"""

_CUBE = f"""k AS (SELECT *, {_GROUP} AS groupe FROM p WHERE {_IN}), y AS (SELECT DISTINCT annee FROM p WHERE annee >= '2021'),
    cube AS (SELECT commune, a.annee AS annee_min, b.annee AS annee_max, groupe, type_local, {_STAT} FROM y a JOIN y b ON a.annee <= b.annee JOIN k ON k.annee BETWEEN a.annee AND b.annee GROUP BY ALL)"""

_COUNTS = f"""k AS (SELECT commune, annee, type_local AS t, {_GROUP} AS g, coalesce(date_mutation, '') >= '2021-07-01' AS inside, match_status = 'resolu_consensus' AS c FROM p WHERE {_SURE} AND annee IS NOT NULL AND commune IS NOT NULL),
    lv AS (SELECT commune, annee, NULL AS type_local, NULL AS groupe, inside, c FROM k UNION ALL SELECT commune, annee, t, NULL, inside, c FROM k WHERE t IN ('Appartement', 'Maison')
           UNION ALL SELECT commune, annee, NULL, g, inside, c FROM k WHERE g IS NOT NULL UNION ALL SELECT commune, annee, t, g, inside, c FROM k WHERE g IS NOT NULL AND t IN ('Appartement', 'Maison')),
    counts AS (SELECT commune, annee, type_local, groupe, count(*) FILTER (inside) AS retenues, count(*) FILTER (inside AND c) AS resolu_consensus, count(*) FILTER (NOT inside) AS pre_reforme_exclus FROM lv GROUP BY ALL)"""

_IRIS_YEAR = "iy AS (SELECT code_iris, nom_iris, annee, type_local, count(*) AS n, avg(prix_m2) AS moyenne FROM p WHERE code_iris IS NOT NULL GROUP BY ALL)"


def _histogram(value: str, source: str) -> str:
    case = " ".join(f"WHEN {value} <= {top} THEN {k}" if top is not None else f"WHEN {value} IS NOT NULL THEN {k}" for k, (_, top) in enumerate(DISTANCE_EDGES))
    dim = ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(DISTANCE_EDGES))
    return f"SELECT d.rang, d.tranche, count(v.rang) AS n FROM (VALUES {dim}) d(rang, tranche) LEFT JOIN (SELECT CASE {case} END AS rang FROM {source}) v ON d.rang = v.rang GROUP BY ALL"


def _accuracy(value: str, edges) -> str:
    dim = ", ".join(f"({lo}::DOUBLE, {hi!r}::DOUBLE)" for lo, hi in zip(edges, edges[1:]))
    return f"SELECT bas, round(haut, 4) AS haut, count({value}) AS n, round(coalesce(avg(correct_top1::INT), 0.0), 4) AS exactitude FROM (VALUES {dim}) d(bas, haut) LEFT JOIN ev ON ev.{value} >= bas AND ev.{value} < haut GROUP BY bas, haut"


_EVALUATED = f"""{_LINK},
    mk AS (SELECT j.*, o.numero_dpe AS reponse, CASE WHEN j.m = 1 THEN 'isole' ELSE 'multi' END AS regime FROM j JOIN o ON {_on('j', 'o')} WHERE o.match_status = 'trouve' AND j.garde),
    tp AS (SELECT *, row_number() OVER (PARTITION BY code, adresse, lat, lon, surface, kind ORDER BY {FAR.format(_hav('lat', 'lon', 'lat_c', 'lon_c'))}) - 1 AS pos FROM mk),
    an AS (SELECT *, ('0x' || substr(md5(numero_dpe), 1, 4))::INT % 201 / 100.0::DOUBLE AS score, ('0x' || substr(md5(numero_dpe), 1, 4))::INT % 101 / 100.0::DOUBLE AS confiance FROM tp WHERE pos < 8),
    rk AS (SELECT *, row_number() OVER w AS r, score - coalesce(lead(score) OVER w, 0.0) AS marge FROM an WINDOW w AS (PARTITION BY code, adresse, lat, lon, surface, kind ORDER BY score DESC, pos)),
    ev AS (SELECT *, motif = 'resolu' AS resolu, coalesce(numero_dpe = reponse, false) AS correct_top1 FROM (SELECT *, CASE WHEN score < 1.5 THEN 'score_insuffisant' WHEN marge < 0.5 THEN 'marge_insuffisante' WHEN confiance < 0.5 THEN 'confiance_insuffisante'
             WHEN NOT regexp_matches(numero_dpe, '[0-8].$') THEN 'garde_noul' ELSE 'resolu' END AS motif FROM rk WHERE r = 1))"""


def all_sql() -> dict[str, str]:
    f, i, m = f"WITH {_LOTS}", f"WITH {_IRIS}", f"WITH {_IMPACT}"
    sel = "commune, annee, type_local"
    return {
        "p4_values": f"""
            WITH v AS (SELECT fichier_id, ligne, {_any_of('date_mutation', 'mutation_le', 'date_acte', 'dt_mut', 'jour_vente')} AS d, {_any_of('prix', 'valeur_fonciere')} AS p,
                         {_any_of('surface', 'm2_habitables', 'surf_bati')} AS s, {_any_of('code_insee', 'depcom', 'codgeo', 'insee_commune', 'code_commune_insee')} AS c FROM dvf_brut),
            t AS (SELECT fichier_id, ligne, json_type(d) AS kind, d ->> '$' AS d, replace(p ->> '$', ',', '.') AS p, replace(s ->> '$', ',', '.') AS s, json_type(c) = 'VARCHAR' AS text, c ->> '$' AS c FROM v)
            SELECT DISTINCT fichier_id, ligne, CASE
                WHEN kind = 'VARCHAR' AND regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(d, '%Y-%m-%d')
                WHEN kind = 'VARCHAR' AND regexp_full_match(d, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime(d, '%d/%m/%Y')
                WHEN regexp_full_match(d, '[0-9]{{8}}') THEN try_strptime(d, '%Y%m%d')
                WHEN kind <> 'VARCHAR' AND d::BIGINT BETWEEN 7305 AND 29219 THEN DATE '1970-01-01' + d::INT END::DATE::VARCHAR AS date_mutation,
              try_cast(p AS DOUBLE) AS prix, try_cast(s AS DOUBLE) AS surface, CASE WHEN text THEN c ELSE lpad(c, 5, '0') END AS code_insee FROM t""",
        "p4_types": """
            SELECT flux, champ, type, count(*) AS n, arg_min(fichier_id, (recu_le, fichier_id)) AS premier_fichier FROM (
              SELECT fichier_id, e.key AS champ, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' END AS type
              FROM dvf_brut, json_each(contenu) e WHERE e.type <> 'NULL') JOIN (SELECT DISTINCT fichier_id, flux, recu_le FROM dvf_fichiers) USING (fichier_id) GROUP BY flux, champ, type""",
        "p6_found": f"""
            WITH s AS (SELECT DISTINCT lot_id, lat, lon, floor(lat / 0.0002)::BIGINT AS cy FROM dvf_geocoded WHERE lat IS NOT NULL AND lon IS NOT NULL),
            cc AS (SELECT s.*, s.cy + d AS ky FROM s, (VALUES (-1), (0), (1)) t(d)),
            v AS (SELECT DISTINCT least(a.lot_id, b.lot_id) AS lot_a, greatest(a.lot_id, b.lot_id) AS lot_b FROM s a JOIN cc b ON a.cy = b.ky
                  WHERE abs(a.lon - b.lon) < 0.0006 AND a.lot_id <> b.lot_id AND (a.lat <> b.lat OR a.lon <> b.lon) AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15),
            {_PIP}
            SELECT 'voisin' AS genre, lot_a, lot_b, '' AS code_iris FROM v
            UNION ALL SELECT DISTINCT 'region', lot_id, 0, coalesce(h1.code, '') FROM pt LEFT JOIN h1 USING (lot_id, lat, lon) WHERE recorded <> coalesce(h1.code, '')""",
        "scan_s1_projection": "SELECT lot_id, commune, type_local, surface FROM dvf_clean",
        "scan_s2_several_files": "SELECT lot_id, lat, lon FROM dvf_geocoded UNION ALL SELECT lot_id, lat, lon FROM dvf_iris",
        "scan_s17_mart": "SELECT edition, commune, annee, type_local, n, moyenne, mediane FROM agg_marche",
        "sink_k1_conform": "SELECT lot_id, date_mutation::VARCHAR AS date_mutation, prix, nombre_pieces_principales, NULL::VARCHAR AS etage FROM dvf_clean",
        "sink_k3_total_order": "SELECT commune, code_insee, no_disposition, nature_mutation, date_mutation, type_local, surface, prix, match_status, etiquette_dpe FROM dvf_dpe_matched ORDER BY ALL",
        "sink_k5_cube_lines": "SELECT to_json({'annee': annee, 'commune': commune, 'mediane': round(mediane, 1), 'moyenne': round(moyenne, 1), 'n': n, 'type_local': type_local})::VARCHAR AS value FROM agg_marche",
        "sink_k6_slim_geojson": """SELECT code_iris, nom_iris, NULL::VARCHAR AS code_insee, nom_commune, CASE WHEN json_extract_string(geometry, '$.type') = 'Polygon'
            THEN to_json({'type': 'Polygon', 'coordinates': list_transform(from_json(json_extract(geometry, '$.coordinates'), '[[["DOUBLE"]]]'), lambda r: list_transform(r, lambda p: list_transform(p, lambda x: round(x, 5))))})::VARCHAR
            ELSE to_json({'type': 'MultiPolygon', 'coordinates': list_transform(from_json(json_extract(geometry, '$.coordinates'), '[[[["DOUBLE"]]]]'), lambda g: list_transform(g, lambda r: list_transform(r, lambda p: list_transform(p, lambda x: round(x, 5)))))})::VARCHAR END AS geometry FROM iris_polygones""",
        "filter_p1_perimeter": "SELECT lot_id, code_insee FROM dvf_clean WHERE code_insee IN ('96007', '00356', '00017')",
        "filter_p3_row_class": "SELECT CASE WHEN coalesce(prix, 0) = 0 THEN 'excluded_zero_price' WHEN coalesce(surface, 0) = 0 THEN 'excluded_zero_surface' ELSE 'kept' END AS classe, count(*) AS n FROM dvf_clean GROUP BY 1",
        "filter_p4_clean_lots": f"""WITH r AS (SELECT *, regexp_extract(adresse_brute, '^ *([0-9]+)?( *(?:BIS|TER) )? *([A-Za-z]+)?(.*)$', ['a', 'b', 'c', 'd']) AS x FROM dvf_clean),
            a AS (SELECT *, coalesce(concat_ws(' ', {', '.join(f"nullif(trim(x.{k}), '')" for k in 'abcd')}), '') AS whole FROM r)
            SELECT DISTINCT lot_id, prix::DECIMAL(18,2)::DOUBLE AS prix, surface::DECIMAL(18,1)::DOUBLE AS surface, whole AS adresse_brute, {_normal('whole')} AS adresse_normalisee,
            CASE WHEN coalesce(prix, 0) = 0 THEN 'excluded_zero_price' WHEN coalesce(surface, 0) = 0 THEN 'excluded_zero_surface' ELSE 'kept' END AS classe FROM a""",
        "filter_p5_date_class": """SELECT CASE WHEN coalesce(date_etablissement_dpe, '') = '' THEN 'missing_date' WHEN NOT regexp_full_match(date_etablissement_dpe, '\\d{4}-\\d{2}-\\d{2}') OR try_cast(date_etablissement_dpe AS DATE) IS NULL THEN 'invalid_date'
            WHEN date_etablissement_dpe >= '2021-07-01' THEN 'post_reform' ELSE 'pre_reform' END AS classe, count(*) AS n FROM dpe_clean GROUP BY 1""",
        "filter_p6_clean_certificates": f"""SELECT DISTINCT numero_dpe, {_normal('adresse_brut')} AS adresse_normalisee, {_query_text('adresse_brut', 'reverse(code_postal_ban)', 'upper(nom_commune_ban)', False)} AS adresse_geocodage,
            CASE WHEN coalesce(date_etablissement_dpe, '') = '' THEN 'missing_date' WHEN NOT regexp_full_match(date_etablissement_dpe, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR try_cast(date_etablissement_dpe AS DATE) IS NULL THEN 'invalid_date'
            WHEN date_etablissement_dpe >= '2021-07-01' THEN 'post_reform' ELSE 'pre_reform' END AS classe FROM dpe_clean""",
        "filter_p8_market": "SELECT * FROM agg_marche WHERE type_local = 'Maison' AND annee BETWEEN '2019' AND '2022'",
        "filter_p9_iris": "SELECT * FROM agg_iris WHERE substr(code_iris, 1, 5) = '96007' AND type_local = 'Appartement'",
        "filter_p10_selection": f"SELECT match_id, commune, date_mutation, etiquette_dpe FROM dvf_dpe_matched WHERE type_local = 'Appartement' AND date_mutation BETWEEN '2020-01-01' AND '2023-12-31' AND {_GROUP} = 'A-C'",
        "filter_p11_certain_after_reform": f"SELECT match_id, match_status, date_mutation FROM dvf_dpe_matched WHERE {_IN}",
        "clean_latest_delivery": "SELECT lot_id, max(recu_le)::VARCHAR AS recu_le, arg_max(prix, recu_le) AS prix FROM (SELECT DISTINCT * FROM dvf_clean) GROUP BY lot_id",
        "fn_f1_french_decimal": "SELECT DISTINCT lot_id, surface::DECIMAL(18,1)::DOUBLE AS surface FROM dvf_clean",
        "fn_f2_compose": f"SELECT DISTINCT lot_id, concat_ws(' ', {_part('code_postal')}, {_part('type_local')}, {_part('commune')}) AS adresse FROM dvf_clean",
        "fn_f3_normalize_address": f"SELECT DISTINCT adresse_brute, {_normal('adresse_brute')} AS adresse FROM dvf_clean",
        "fn_f4_geocoding_query": f"SELECT DISTINCT lot_id, {_query_text('adresse_brute', 'code_postal', 'commune')} AS requete FROM dvf_clean",
        "fn_f6_geocode_key": "SELECT DISTINCT lower(trim(regexp_replace(adresse_geocodage, '\\s+', ' ', 'g'))) AS cle FROM dpe_clean",
        "fn_f7_label_group": f"SELECT etiquette_dpe, {_GROUP} AS groupe, count(*) AS n FROM dvf_dpe_matched GROUP BY ALL",
        "fn_f8_registry_town": "SELECT DISTINCT nom_commune_ban, replace(upper(strip_accents(nom_commune_ban)), '''', ' ') AS nom FROM dpe_clean",
        "fn_f9_haversine": f"SELECT DISTINCT lot_id, round({_hav('lat', 'lon', '42.0', '-30.5')}, 3) AS m FROM dvf_geocoded",
        "fn_f14_cache_key": "SELECT match_id, sha256(to_json({'p0': coalesce(code_insee, '∅'), 'p1': coalesce(no_disposition, '∅'), 'p2': coalesce(date_mutation, '∅'), 'p3': coalesce(trim(adresse_brute), '∅'), 'p4': 'v1'})) AS cle FROM dvf_dpe_matched",
        "fn_f23_class_edges": "WITH v AS (SELECT list(mediane ORDER BY mediane) AS l FROM agg_iris WHERE mediane IS NOT NULL) SELECT list_sort(list_distinct(list_transform(range(1, 7), lambda i: l[(i * len(l) // 7) + 1]))) AS bornes FROM v",
        "fn_f24_extent": f"WITH {_BOX} SELECT *, (ouest + est) / 2 AS lon, (sud + nord) / 2 AS lat FROM box",
        "join_j1_calibration": f"WITH {_PAIRS} SELECT adresse, round(distance_m, 3) AS distance_m FROM pairs",
        "join_j2_exact": f"WITH {_LINK} SELECT code, adresse, kind, numero_dpe FROM ex",
        "join_j3_distance": f"WITH {_LINK} SELECT code, adresse, lat, lon, kind, numero_dpe FROM nr_all",
        "join_j4_without_town": "SELECT DISTINCT numero_dpe FROM dpe_clean WHERE trim(coalesce(code_insee_ban, '')) = ''",
        "join_j5_region": f"""WITH {_PIP.replace('dvf_iris', 'dvf_geocoded').replace("coalesce(code_iris, '')", "''")},
            g AS (SELECT DISTINCT lot_id, lat, lon FROM dvf_geocoded)
            SELECT CASE WHEN g.lat IS NULL OR g.lon IS NULL THEN 'non_geocodee' WHEN h1.code IS NULL THEN 'hors_perimetre_iris' ELSE 'rattachee' END AS etat, count(*) AS n FROM g LEFT JOIN h1 ON g.lot_id = h1.lot_id AND g.lat = h1.lat AND g.lon = h1.lon GROUP BY 1""",
        "join_j6_geocode_cache": f"""WITH g AS (SELECT lower(trim(regexp_replace(concat_ws(' ', adresse_brut, code_postal_ban, nom_commune_ban), '\\s+', ' ', 'g'))) AS cle, max((lat, lon)) AS p FROM dpe_clean GROUP BY 1),
            l AS (SELECT DISTINCT lot_id, lower(trim(regexp_replace({_query_text('adresse_brute', 'code_postal', 'commune')}, '\\s+', ' ', 'g'))) AS cle FROM dvf_clean),
            x AS (SELECT cle, arg_max({{'a': lat, 'b': lon}}, {{'a': coalesce(lat, -1e9), 'b': coalesce(lon, -1e9)}}) AS p FROM (SELECT lower(trim(regexp_replace(concat_ws(' ', adresse_brut, code_postal_ban, nom_commune_ban), '\\s+', ' ', 'g'))) AS cle, lat, lon FROM dpe_clean) GROUP BY 1)
            SELECT CASE WHEN coalesce(l.cle, '') = '' THEN 'no_address' WHEN x.cle IS NULL THEN 'missing' WHEN x.p.a IS NULL OR x.p.b IS NULL THEN 'not_found' ELSE 'found' END AS statut_geocodage, count(*) AS n FROM l LEFT JOIN x ON l.cle = x.cle GROUP BY 1""",
        "join_j6_to_look_up": f"""SELECT DISTINCT cle FROM (SELECT lower(trim(regexp_replace({_query_text('adresse_brute', 'code_postal', 'commune')}, '\\s+', ' ', 'g'))) AS cle FROM dvf_clean) WHERE coalesce(cle, '') <> ''
            AND cle NOT IN (SELECT lower(trim(regexp_replace(concat_ws(' ', adresse_brut, code_postal_ban, nom_commune_ban), '\\s+', ' ', 'g'))) FROM dpe_clean)""",
        "join_j9_choropleth": "SELECT g.code_iris, g.nom_iris, g.nom_commune, round(a.mediane, 4) AS valeur, coalesce(a.n, 0) AS n FROM iris_polygones g LEFT JOIN (SELECT * FROM agg_iris WHERE edition = 0 AND type_local = 'Maison' AND mediane IS NOT NULL) a USING (code_iris)",
        "join_j11_status_grid": "SELECT commune, count(*) FILTER (match_status = 'trouve') AS trouve, count(*) FILTER (match_status = 'resolu_consensus') AS resolu_consensus, count(*) FILTER (match_status = 'non_trouve') AS non_trouve, count(*) FILTER (match_status = 'ambigu') AS ambigu FROM dvf_dpe_matched GROUP BY 1",
        "link_l1_dedup": f"WITH {_LINK} SELECT numero_dpe, adresse_normalisee, lat, lon FROM d",
        "link_l8_cascade": f"WITH {_LINKED} SELECT * EXCLUDE (date_mutation) FROM linked",
        "link_l11_undecided": f"WITH {_LINK} SELECT j.code, j.adresse, j.lat, j.lon, j.surface, j.kind, j.numero_dpe FROM j JOIN o ON {_on('j', 'o')} WHERE o.match_status = 'ambigu' AND j.retenu",
        "link_l12_masked": f"WITH {_LINK} SELECT j.code, j.adresse, j.lat, j.lon, j.surface, j.kind, j.numero_dpe, o.numero_dpe AS reponse, CASE WHEN j.m = 1 THEN 'isole' ELSE 'multi' END AS regime FROM j JOIN o ON {_on('j', 'o')} WHERE o.match_status = 'trouve' AND j.garde",
        "link_l13_report": f"""WITH {_LINKED} SELECT count(*) AS total, count(*) FILTER (match_status = 'trouve') AS trouve, count(*) FILTER (match_status = 'resolu_consensus') AS resolu_consensus, count(*) FILTER (match_status = 'non_trouve') AS non_trouve,
            count(*) FILTER (match_status = 'ambigu') AS ambigu, count(*) FILTER (filtre_type_applique) AS filtre_type, count(*) FILTER ({_SURE} AND coalesce(date_mutation, '') < '2021-07-01') AS pre_reforme,
            (SELECT count(*) FROM dpe_clean WHERE trim(coalesce(code_insee_ban, '')) = '') AS dpe_sans_commune FROM linked""",
        "agg_a1_by_keys": "SELECT commune, type_local, count(*) AS n, round(avg(prix), 4) AS moyenne, round(median(prix), 4) AS mediane FROM dvf_clean WHERE prix IS NOT NULL GROUP BY 1, 2",
        "agg_a2_sales": f"{f} SELECT {_KEYS}, commune, type_local, round(prix_m2, 4) AS prix_m2, annee, n_lots FROM p",
        "agg_a2_exclusions": f"{f} SELECT count(*) AS n_mutations, count(*) FILTER (motif IS NULL) AS n_points, {', '.join(f'''count(*) FILTER (motif = '{r}') AS {r}''' for r in ('sans_habitation', 'mixte', 'nature', 'inexploitable', 'hors_bande'))} FROM s",
        "agg_a3_impact_counts": f"{m} SELECT count(*) AS n_points, count(*) FILTER ({_SURE}) AS etiquette_certaine, count(*) FILTER ({_IN}) AS retenues, count(*) FILTER ({_IN} AND match_status = 'resolu_consensus') AS resolu_consensus, count(*) FILTER ({_SURE} AND NOT (coalesce(date_mutation, '') >= '2021-07-01')) AS pre_reforme FROM p",
        "agg_a4_market": f"{f} SELECT {sel}, {_STAT} FROM p GROUP BY ALL",
        "agg_a5_labels": f"{m} SELECT etiquette_dpe, type_local, {_STAT} FROM p WHERE {_IN} GROUP BY ALL",
        "agg_a6_iris": f"{i} SELECT code_iris, nom_iris, type_local, {_STAT} FROM p WHERE code_iris IS NOT NULL GROUP BY ALL",
        "agg_a7_iris_year": f"{i} SELECT code_iris, nom_iris, annee, type_local, {_STAT} FROM p WHERE code_iris IS NOT NULL GROUP BY ALL",
        "agg_a8_trend": f"{f} SELECT annee, {_STAT} FROM p WHERE type_local = 'Appartement' AND annee >= '2017' GROUP BY ALL",
        "agg_a9_impact": f"{m} SELECT {_GROUP} AS groupe, type_local, {_STAT} FROM p WHERE {_IN} AND date_mutation BETWEEN '2022-01-01' AND '2024-12-31' GROUP BY ALL",
        "agg_a10_breakdown": f"{m} SELECT count(*) FILTER ({_IN}) AS retenues, count(*) FILTER ({_IN} AND match_status = 'resolu_consensus') AS resolu_consensus, count(*) FILTER ({_SURE} AND NOT (coalesce(date_mutation, '') >= '2021-07-01')) AS pre_reforme_exclus FROM p WHERE type_local = 'Appartement' AND {_GROUP} = 'D'",
        "agg_a11_statuses": "SELECT match_status, count(*) AS n FROM dvf_dpe_matched GROUP BY 1",
        "agg_a12_rate": """WITH d(rang, status) AS (VALUES (0, 'trouve'), (1, 'resolu_consensus'), (2, 'non_trouve'), (3, 'ambigu')), c AS (SELECT rang, status, count(match_id) AS n FROM d LEFT JOIN dvf_dpe_matched ON match_status = status GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c)
            SELECT rang, status, n, round(CASE WHEN t > 0 THEN n / t * 100 ELSE 0.0 END, 4) AS pct FROM c, t UNION ALL SELECT 4, 'etiquette_certaine', sum(n) FILTER (rang < 2)::BIGINT, round(CASE WHEN min(t) > 0 THEN sum(n) FILTER (rang < 2) / min(t) * 100 ELSE 0.0 END, 4) FROM c, t""",
        "agg_a13_town_matching": "SELECT commune, match_status, count(*) AS n FROM dvf_dpe_matched GROUP BY 1, 2",
        "agg_a14_best_status": f"""WITH b AS (SELECT {_KEYS}, max(CASE match_status WHEN 'trouve' THEN 3 WHEN 'resolu_consensus' THEN 2 WHEN 'ambigu' THEN 1 WHEN 'non_trouve' THEN 0 ELSE -1 END) AS r FROM dvf_dpe_matched WHERE {_HOME} GROUP BY ALL)
            SELECT CASE r WHEN 3 THEN 'trouve' WHEN 2 THEN 'resolu_consensus' WHEN 1 THEN 'ambigu' WHEN 0 THEN 'non_trouve' END AS match_status, count(*) AS n FROM b GROUP BY 1""",
        "agg_a15_vintage": "SELECT count(*) AS n, min(date_mutation)::VARCHAR AS debut, max(date_mutation)::VARCHAR AS fin FROM dvf_clean",
        "agg_a16_by_town": "SELECT code_insee_ban, count(*) AS n FROM dpe_clean GROUP BY 1",
        "agg_a17_distances": f"WITH {_PAIRS} SELECT count(distance_m) AS n, round(avg(distance_m), 3) AS moyenne, round(min(distance_m), 3) AS minimum, round(max(distance_m), 3) AS maximum, {', '.join(f'round(quantile_cont(distance_m, {q / 100}), 3) AS p{q}' for q in (50, 75, 90, 95, 99))} FROM pairs",
        "agg_a18_histogram": f"WITH {_PAIRS} {_histogram('round(distance_m, 6)', 'pairs')}",
        "agg_a21_colour_range": "SELECT min(mediane) AS zmin, max(mediane) AS zmax FROM agg_iris WHERE type_local = 'Maison'",
        "agg_a22_centre": f"WITH {_BOX} SELECT round((min(sud) + max(nord)) / 2, 6) AS lat, round((min(ouest) + max(est)) / 2, 6) AS lon FROM box WHERE code_iris LIKE '96%'",
        "agg_a25_readd": f"{i}, {_IRIS_YEAR} SELECT code_iris, type_local, sum(n)::BIGINT AS n, round(sum(moyenne * n) / sum(n), 4) AS moyenne FROM iy WHERE annee BETWEEN '2018' AND '2022' GROUP BY 1, 2",
        "agg_a25_readd_counts": f"{m}, {_COUNTS} SELECT commune, sum(retenues)::BIGINT AS retenues, sum(resolu_consensus)::BIGINT AS resolu_consensus, sum(pre_reforme_exclus)::BIGINT AS pre_reforme_exclus FROM counts WHERE type_local IS NULL AND groupe IS NULL AND annee BETWEEN '2021' AND '2024' GROUP BY 1",
        "sort_o2_series": "SELECT * FROM agg_marche WHERE commune = 'Vaumirac' AND type_local = 'Maison' ORDER BY annee, edition",
        "sort_o5_sample": "SELECT match_id, sha256(match_id::VARCHAR) AS cle FROM dvf_dpe_matched ORDER BY cle LIMIT 50",
        "sort_o6_stratified": "SELECT match_id, match_status, cle FROM (SELECT *, row_number() OVER (PARTITION BY match_status ORDER BY cle) AS r FROM (SELECT match_id, match_status, sha256(match_id::VARCHAR) AS cle FROM dvf_dpe_matched)) WHERE r <= 20",
        "sort_o7_years": "SELECT min(annee) AS premiere, max(annee) AS derniere FROM agg_marche",
        "cube_m1_impact": f"{m}, {_CUBE} SELECT * FROM cube",
        "cube_m2_counts": f"{m}, {_COUNTS} SELECT * FROM counts",
        "cube_m3_iris_sums": f"{i}, {_IRIS_YEAR} SELECT code_iris, nom_iris, annee, type_local, n, round(moyenne * n, 2) AS somme FROM iy",
        "cube_m4_trend_by_type": f"{f} SELECT type_local, annee, {_STAT} FROM p WHERE type_local IN ('Appartement', 'Maison') GROUP BY ALL",
        "cube_m5_ladder": f"{m}, k AS (SELECT * FROM p WHERE {_IN}) SELECT 'ensemble' AS niveau, NULL AS commune, etiquette_dpe, type_local, {_STAT} FROM k GROUP BY etiquette_dpe, type_local UNION ALL SELECT 'commune', commune, etiquette_dpe, type_local, {_STAT} FROM k GROUP BY commune, etiquette_dpe, type_local",
        "cube_m6_towns": """WITH a AS (SELECT * FROM agg_marche WHERE edition = 1), g AS (SELECT * FROM (SELECT DISTINCT commune FROM a), (VALUES ('Appartement'), ('Maison')) t(type_local))
            SELECT g.commune, g.type_local, '2024' AS annee, round(c.mediane, 4) AS mediane, round(c.moyenne, 4) AS moyenne, coalesce(c.n, 0) AS n, '2019' AS annee_base, coalesce(b.n, 0) AS n_base, round(CASE WHEN b.moyenne <> 0 THEN c.moyenne / b.moyenne - 1 END, 4) AS evolution
            FROM g LEFT JOIN a c ON c.commune = g.commune AND c.type_local = g.type_local AND c.annee = '2024' LEFT JOIN a b ON b.commune = g.commune AND b.type_local = g.type_local AND b.annee = '2019'""",
        "cube_m7_iris_map": "SELECT code_iris, nom_iris, moyenne AS valeur, n FROM agg_iris WHERE edition = 0 AND type_local = 'Appartement' AND substr(code_iris, 1, 5) = '96007' AND moyenne IS NOT NULL",
        "cube_m8_evolution": """WITH s AS (SELECT annee, moyenne AS prix FROM agg_marche WHERE edition = 0 AND commune = 'Vaumirac' AND type_local = 'Maison'),
            w AS (SELECT * FROM (VALUES (1), (5)) t(f) UNION ALL SELECT 2025 - min(annee)::INT FROM s HAVING 2025 - min(annee)::INT > 5)
            SELECT f::INT AS fenetre_ans, (2025 - f)::VARCHAR AS annee_debut, '2025' AS annee_fin, round(a.prix, 4) AS prix_debut, round(b.prix, 4) AS prix_fin, round(CASE WHEN a.prix <> 0 THEN b.prix - a.prix END, 4) AS variation_eur,
            round(CASE WHEN a.prix <> 0 THEN (b.prix - a.prix) / a.prix * 100 END, 4) AS variation_pct, CASE WHEN b.prix IS NULL THEN 'annee de fin absente' WHEN a.prix IS NULL THEN 'annee de depart absente' WHEN a.prix = 0 THEN 'prix de depart nul' END AS raison
            FROM w LEFT JOIN s a ON a.annee = (2025 - f)::VARCHAR LEFT JOIN s b ON b.annee = '2025'""",
        "cube_m10_label_arrays": f"{m} SELECT commune, type_local, {', '.join(f'''count(*) FILTER (etiquette_dpe = '{x}') AS n_{x}''' for x in 'ABCDEFG')} FROM p WHERE {_IN} GROUP BY 1, 2",
        "cube_m12_discount": f"""{m}, a AS (SELECT commune, type_local, etiquette_dpe, count(*) AS n, avg(prix_m2) AS pm2 FROM p WHERE {_IN} GROUP BY ALL),
            r AS (SELECT commune, type_local, pm2 AS ref FROM a WHERE etiquette_dpe = 'D')
            SELECT a.commune, a.type_local, a.etiquette_dpe, a.n, round(a.pm2, 4) AS pm2_moyen, round(CASE WHEN ref <> 0 THEN (pm2 - ref) / ref * 100 END, 4) AS ecart_pct FROM a LEFT JOIN r ON a.commune IS NOT DISTINCT FROM r.commune AND a.type_local IS NOT DISTINCT FROM r.type_local""",
        "cube_m13_series": f"{m}, {_CUBE} SELECT * FROM cube WHERE commune = 'Vaumirac' AND annee_min = '2021' AND annee_max = '2023'",
        "score_d4_decisions": f"WITH {_EVALUATED} SELECT code, adresse, numero_dpe, round(score, 4) AS score, round(marge, 4) AS marge, round(confiance, 4) AS confiance, motif, correct_top1, CASE WHEN resolu THEN 'resolu_jev' ELSE 'ambigu' END AS match_status FROM ev",
        "score_a19_accuracy": f"WITH {_EVALUATED} {_accuracy('confiance', CONFIDENCE_EDGES)}",
        "score_a19_margins": f"WITH {_EVALUATED} {_accuracy('marge', MARGIN_EDGES)}",
        "score_a20_summary": f"""WITH {_EVALUATED} SELECT d.regime, count(ev.regime) AS n, round(coalesce(count(*) FILTER (correct_top1) / nullif(count(ev.regime), 0), 0.0), 4) AS exactitude_top1, count(*) FILTER (resolu) AS resolus,
            round(coalesce(count(*) FILTER (resolu AND correct_top1) / nullif(count(*) FILTER (resolu), 0), 0.0), 4) AS exactitude_a_seuil, round(1 - count(*) FILTER (resolu AND correct_top1) / nullif(count(*) FILTER (resolu), 0), 4) AS taux_erreur_residuel
            FROM (VALUES ('isole'), ('multi')) d(regime) LEFT JOIN ev ON ev.regime = d.regime GROUP BY 1""",
    } | case_sql(_LINK, _on('j', 'o'), _hav('lat', 'lon', 'lat_c', 'lon_c'), _EVALUATED, _BOX, m, i, f, _COUNTS, _IN, _STAT)
