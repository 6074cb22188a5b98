"""DuckDB SQL that must give the same rows as the queries, written from the meaning of each, not from their code."""

from __future__ import annotations

FILES = r"""
f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'original' WHEN '2' THEN 'correo' ELSE 'whatsapp' END AS folder,
         CASE WHEN l_partkey % 17 = 0 THEN 'IMG_' || l_orderkey || '.jpg'
              ELSE (100000000 + l_orderkey) || '_' || ['INCAPACIDAD', 'EPICRISIS', 'FURAT', 'HISTORIA', 'PERMISO', 'FURIPS', 'OTRO'][l_linenumber] || '.pdf' END AS name
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
p AS (
  SELECT *, folder || '/' || name AS path, upper(folder) AS channel,
         nullif(regexp_extract(name, '^([0-9]{5,15})[_-]([A-Za-zÑñ]+)(?:[_-]([0-9]{1,3}))?[.][a-z]+$', 1), '') AS id_number,
         upper(nullif(regexp_extract(name, '^([0-9]{5,15})[_-]([A-Za-zÑñ]+)(?:[_-]([0-9]{1,3}))?[.][a-z]+$', 2), '')) AS doc_type
  FROM f)"""
CASES = FILES + r""",
c AS (
  SELECT id_number AS case_id,
         list_sort(list_distinct(list(CASE doc_type WHEN 'HISTORIA' THEN 'HISTORIA_CLINICA' ELSE doc_type END))) AS present,
         count(*) AS n_files, count(*) FILTER (doc_type IN ('INCAPACIDAD', 'PERMISO', 'VACACIONES')) AS n_base,
         min(path) FILTER (doc_type IN ('INCAPACIDAD', 'PERMISO', 'VACACIONES')) AS base,
         arg_min(doc_type, path) FILTER (doc_type IN ('INCAPACIDAD', 'PERMISO', 'VACACIONES')) AS base_type,
         min(path) AS first_path, arg_min(channel, path) AS channel
  FROM p WHERE id_number IS NOT NULL GROUP BY id_number),
r AS (
  SELECT *, [2, 3, 11][n_files % 3 + 1] AS type_id,
         CASE n_files % 3 WHEN 0 THEN ['INCAPACIDAD', 'FURAT'] WHEN 1 THEN ['INCAPACIDAD', 'EPICRISIS'] ELSE ['INCAPACIDAD', 'FURIPS'] END AS required
  FROM c),
k AS (
  SELECT *, [d FOR d IN required IF NOT (list_contains(present, d) OR (d = 'EPICRISIS' AND list_has_any(present, ['HISTORIA_CLINICA', 'RESUMEN_ATENCION'])))] AS missing
  FROM r)"""
CLAIMS = r"""
cl AS (
  SELECT o_orderkey AS claim_id, o_orderkey AS k, o_custkey,
         CASE WHEN k % 11 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS person_key,
         CASE WHEN k % 2 = 0 THEN 'Sr Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS person_name,
         CASE WHEN k % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS s,
         CASE WHEN k % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(k % 30 - CASE WHEN k % 50 = 3 THEN 40 ELSE 0 END AS INTEGER) END AS e,
         CASE WHEN k % 6 <> 0 THEN CAST(k % 30 + CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) END AS n,
         CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'SOAT NACIONAL' WHEN k % 9 IN (2, 3) THEN 'EPS NATION_' || (k % 25) ELSE 'EPS ' || o_orderpriority END AS insurer_text,
         CASE WHEN k % 13 <> 0 THEN CAST(k % 2500 AS VARCHAR) END AS dx_code,
         ['incapacidad', 'permiso', 'vacaciones'][k % 3 + 1] AS kind,
         k % 10 = 0 AS anchored,
         ['Accidente de TRABAJO', 'enfermedad laboral', 'licencia de Maternidad', 'Licencia por paternidad', 'prelicencia', 'Tránsito urbano',
          'Enfermedad común', 'control general'][k % 8 + 1] AS phrase,
         [2, 8, 5, 9, 10, 11, 3, 3][k % 8 + 1] AS phrase_type,
         CASE k % 4 WHEN 0 THEN 'REMUNERADO' WHEN 1 THEN 'NO_REMUNERADO' END AS paid,
         CASE WHEN k % 97 = 0 THEN '1' END AS o_cedula, CASE WHEN k % 101 = 0 THEN 9 END AS o_tipo,
         CASE WHEN k % 103 = 0 THEN '12' WHEN k % 107 = 0 THEN 'x' END AS o_dias,
         CASE WHEN k % 109 = 0 THEN '2031-01-05' WHEN k % 113 = 0 THEN '2031-02-31' END AS o_start,
         ['WHATSAPP', 'CORREO', 'ORIGINAL', 'WHATSAPP'][k % 4 + 1] AS channel
  FROM (SELECT *, o_orderkey AS k FROM orders)),
ra AS (
  SELECT *, coalesce(s IS NULL AND e IS NOT NULL AND n BETWEEN 1 AND 540, false) AS calc,
         CASE WHEN n BETWEEN 1 AND 540 AND s IS NOT NULL AND (e IS NULL OR e - s + 1 <> n) THEN s + (n - 1) ELSE e END AS e1,
         CASE WHEN s IS NULL AND e IS NOT NULL AND n BETWEEN 1 AND 540 THEN e - (n - 1) ELSE s END AS s1,
         CASE WHEN s IS NOT NULL AND e IS NOT NULL AND (n IS NULL OR n NOT BETWEEN 1 AND 540) AND e - s + 1 BETWEEN 1 AND 540 THEN e - s + 1 ELSE n END AS n1
  FROM cl),
rb AS (
  SELECT *, CASE WHEN e1 - s1 NOT BETWEEN 0 AND 540 AND NOT anchored THEN NULL ELSE s1 END AS s2,
         CASE WHEN e1 - s1 NOT BETWEEN 0 AND 540 AND anchored THEN NULL ELSE e1 END AS e2
  FROM ra)"""
KEYWORDS = r""",
texts AS (SELECT DISTINCT t FROM (SELECT insurer_text AS t FROM cl UNION ALL SELECT n_name FROM nation) WHERE t IS NOT NULL),
kw AS (SELECT t, min(n_nationkey) AS id FROM texts JOIN nation ON contains(lower(replace(t, ' ', '')), lower(replace(n_name, ' ', ''))) GROUP BY t)"""
MAPPED = CLAIMS + KEYWORDS + r""",
ma AS (
  SELECT *, coalesce(o_cedula, person_key) AS number, kind = 'incapacidad' AS with_code,
         CASE WHEN o_start IS NOT NULL THEN TRY_CAST(o_start AS DATE) ELSE s2 END AS s3,
         CASE WHEN o_dias IS NOT NULL THEN TRY_CAST(o_dias AS INTEGER) ELSE n1 END AS n3
  FROM rb),
mb AS (SELECT *, CASE WHEN s3 IS NULL AND e2 IS NOT NULL AND n3 BETWEEN 1 AND 540 THEN e2 - (CAST(n3 AS INTEGER) - 1) ELSE s3 END AS start FROM ma),
mc AS (
  SELECT *, CAST(CASE WHEN (n3 IS NULL OR n3 = 0) AND e2 - start + 1 BETWEEN 1 AND 540 THEN e2 - start + 1 ELSE n3 END AS INTEGER) AS days FROM mb),
md AS (
  SELECT mc.*, coalesce(a.c_custkey, b.c_custkey) AS emp_id, coalesce(a.c_name, b.c_name) AS emp_name,
         CASE WHEN a.c_custkey IS NOT NULL THEN na.n_name ELSE nb.n_name END AS emp_ins
  FROM mc LEFT JOIN customer a ON CAST(a.c_custkey AS VARCHAR) = mc.number
  LEFT JOIN customer b ON a.c_custkey IS NULL AND b.c_name = substr(mc.person_name, 4)
  LEFT JOIN nation na ON na.n_nationkey = a.c_nationkey LEFT JOIN nation nb ON nb.n_nationkey = b.c_nationkey),
me AS (
  SELECT md.*, p_partkey AS dx_id, p_type AS dx_text, coalesce(contains(lower(insurer_text), 'soat'), false) AS is_traffic
  FROM md LEFT JOIN part ON with_code AND CAST(p_partkey AS VARCHAR) = dx_code),
mf AS (
  SELECT me.*, ka.id AS id_a, kb.id AS id_b, with_code AND ka.id IS NULL AND kb.id IS NULL AS ins_unknown
  FROM me LEFT JOIN kw ka ON with_code AND NOT is_traffic AND ka.t = insurer_text LEFT JOIN kw kb ON with_code AND ka.id IS NULL AND kb.t = emp_ins),
mg AS (
  SELECT mf.*, coalesce(id_a, id_b, CASE WHEN ins_unknown THEN 1 END) AS ins_id, id_a IS NULL AND id_b IS NOT NULL AS ins_from_employee,
         n_name AS ins_name, coalesce(n_regionkey % 2 + 1, CASE WHEN ins_unknown THEN 1 END) AS ins_kind,
         CASE WHEN o_tipo IS NOT NULL THEN o_tipo WHEN kind = 'permiso' THEN CASE paid WHEN 'REMUNERADO' THEN 12 WHEN 'NO_REMUNERADO' THEN 7 END
              WHEN kind = 'vacaciones' THEN 13 WHEN is_traffic THEN 11 ELSE phrase_type END AS type_id
  FROM mf LEFT JOIN nation ON n_nationkey = coalesce(id_a, id_b)),
mh AS (
  SELECT *, CASE WHEN ins_id = 1 AND type_id = 3 THEN ['INCAPACIDAD', 'HISTORIA_CLINICA'] WHEN ins_id = 1 AND type_id = 2 THEN ['FURAT']
                 WHEN ins_id = 5 AND type_id = 2 THEN ['INCAPACIDAD', 'FURAT'] WHEN ins_id = 2 AND type_id = 5 THEN ['CERTIFICADO_NACIDO_VIVO']
                 WHEN ins_id = 0 AND type_id = 11 THEN ['FURIPS', 'INCAPACIDAD'] END AS own_required,
         CASE type_id WHEN 2 THEN ['INCAPACIDAD', 'FURAT'] WHEN 8 THEN ['INCAPACIDAD', 'FURAT'] WHEN 3 THEN ['INCAPACIDAD', 'EPICRISIS']
                      WHEN 5 THEN ['INCAPACIDAD', 'HISTORIA_CLINICA', 'CERTIFICADO_NACIDO_VIVO'] WHEN 9 THEN ['INCAPACIDAD', 'REGISTRO_CIVIL_NACIMIENTO']
                      WHEN 11 THEN ['INCAPACIDAD', 'FURIPS'] ELSE ['INCAPACIDAD'] END AS type_required,
         CASE k % 5 WHEN 1 THEN ['INCAPACIDAD'] WHEN 2 THEN ['INCAPACIDAD', 'FURAT'] WHEN 3 THEN ['HISTORIA_CLINICA', 'INCAPACIDAD'] WHEN 4 THEN ['PERMISO', 'VACACIONES'] END AS present
  FROM mg),
mi AS (
  SELECT *, CASE kind WHEN 'permiso' THEN ['PERMISO'] WHEN 'vacaciones' THEN ['VACACIONES'] ELSE coalesce(own_required, type_required) END AS required FROM mh),
mj AS (
  SELECT *, CASE WHEN present IS NULL THEN [d FOR d IN coalesce(own_required, CAST([] AS VARCHAR[])) IF d <> 'INCAPACIDAD']
                 ELSE [d FOR d IN required IF NOT (list_contains(present, d) OR (d IN ('EPICRISIS', 'HISTORIA_CLINICA') AND list_has_any(present, ['EPICRISIS', 'HISTORIA_CLINICA'])))] END AS missing,
         ['', 'ACCIDENTE DE TRABAJO', 'ENFERMEDAD GENERAL', '', 'LICENCIA MATERNIDAD', '', 'LICENCIA NO REMUNERADA', 'ENFERMEDAD LABORAL', 'LICENCIA PATERNIDAD',
          'PRELICENCIA', 'TRANSITO NO LABORAL', 'LICENCIA REMUNERADA', 'VACACIONES'][type_id] AS label,
         CASE type_id WHEN 2 THEN 2 WHEN 3 THEN 9 WHEN 5 THEN 12 WHEN 8 THEN 7 WHEN 9 THEN 13 WHEN 10 THEN 14 WHEN 11 THEN 11 END AS level,
         coalesce(dx_text, CASE WHEN k % 23 = 0 THEN 'texto leido' END) AS dx_note
  FROM mi),
m AS (
  SELECT *, CASE WHEN len(missing) = 0 THEN 'COMPLETA' ELSE 'INCOMPLETA' END AS documents, coalesce(array_to_string(missing, ','), '') AS missing_text,
         nullif(concat_ws('; ',
           CASE WHEN kind = 'permiso' AND type_id IS NULL THEN 'No se identificó si el permiso es remunerado o no remunerado' END,
           CASE WHEN emp_id IS NULL AND number IS NULL THEN 'No se detectó la cédula del paciente' END,
           CASE WHEN emp_id IS NULL AND number IS NOT NULL THEN 'Cédula ' || number || ' no encontrada en empleados' END,
           CASE WHEN with_code AND dx_code IS NULL THEN 'No se detectó el código de diagnóstico (CIE-10)' END,
           CASE WHEN with_code AND dx_code IS NOT NULL AND dx_id IS NULL THEN 'Diagnóstico ' || dx_code || ' no está en el catálogo CIE-10' END,
           CASE WHEN ins_unknown THEN CASE WHEN is_traffic THEN 'SOAT: no se pudo determinar la EPS del empleado en el catálogo' ELSE 'EPS no identificada en el documento' END END,
           CASE WHEN start IS NULL THEN 'No se detectó la fecha de inicio' END,
           CASE WHEN days IS NULL OR days = 0 THEN 'No se detectó el número de días' WHEN days NOT BETWEEN 1 AND 540 THEN 'Número de días fuera de rango (=' || days || ')' END,
           CASE WHEN present IS NOT NULL AND len(missing) > 0 THEN 'Faltan documentos requeridos: ' || array_to_string(missing, ', ') END), '') AS problems,
         concat_ws(',',
           CASE WHEN kind = 'permiso' AND type_id IS NULL THEN 'tipo' END, CASE WHEN emp_id IS NULL THEN concat_ws('=', 'cedula', number) END,
           CASE WHEN with_code AND dx_id IS NULL THEN concat_ws('=', 'cie10', dx_code) END, CASE WHEN ins_unknown THEN concat_ws('=', 'eps', insurer_text) END,
           CASE WHEN start IS NULL THEN 'fecha_inicio' END,
           CASE WHEN days IS NULL OR days = 0 THEN 'dias' WHEN days NOT BETWEEN 1 AND 540 THEN 'dias=' || days END) AS fields,
         left(CASE WHEN kind = 'permiso' THEN concat_ws(' | ', label, CASE WHEN k % 2 = 0 THEN 'Empresa: Faro SA' END, CASE WHEN k % 5 = 0 THEN 'Cargo: Analista' END,
                CASE WHEN k % 22 = 0 THEN 'Autorizado por: Jefa (Gerente)' WHEN k % 11 = 0 THEN 'Autorizado por: Jefa' END,
                CASE WHEN k % 7 = 0 THEN 'Horas: ' || CASE WHEN k % 3 = 1 THEN '8:00' ELSE '?' END || '-? (3h)' END)
              ELSE concat_ws(' | ', label, CASE WHEN NOT with_code THEN NULL WHEN dx_code IS NULL THEN dx_note ELSE 'DX ' || dx_code || coalesce(' - ' || dx_note, '') END,
                CASE WHEN k % 17 = 0 THEN 'Tipo licencia: PARTO VIABLE' END, CASE WHEN k % 19 = 0 THEN 'Exp 2031-03-01' END) END, 500) AS notes,
         coalesce(emp_name, person_name) AS person,
         round(CASE WHEN with_code THEN (CAST(number IS NOT NULL AS INTEGER) + CAST(start IS NOT NULL AS INTEGER) + CAST(coalesce(days <> 0, false) AS INTEGER) + CAST(dx_code IS NOT NULL AS INTEGER)) / 4.0
                    ELSE (CAST(number IS NOT NULL AS INTEGER) + CAST(start IS NOT NULL AS INTEGER) + CAST(coalesce(days <> 0, false) AS INTEGER)) / 3.0 END, 3) AS share
  FROM mj),
st AS (
  SELECT claim_id, claim_id AS id, channel, DATE '2031-01-01' AS fecharegistro, start AS fechainicio, days AS "Numerodias",
         CASE WHEN days BETWEEN 1 AND 540 THEN start + days END AS fechavencimiento, CAST(NULL AS VARCHAR) AS numeroorden, notes AS observaciones,
         CAST(channel = 'ORIGINAL' AS INTEGER) AS original, dx_id AS idlpdiagnosticos, emp_id AS idlpempleado, type_id AS idlptipoausentismo,
         level AS idlpnivelincapacidad, ins_id AS idlpentidad, ins_kind AS tipoentidad,
         CASE channel WHEN 'ORIGINAL' THEN 1 WHEN 'CORREO' THEN 3 ELSE 2 END AS idlpestadosrecepausentismos, number AS cedula_leida,
         CASE WHEN with_code THEN dx_code END AS codigo_diagnostico_leido, CASE WHEN with_code THEN insurer_text END AS eps_leida, person AS paciente_leido,
         'stub' AS ocr_backend, 'rule-based' AS extractor, claim_id || '.pdf' AS archivo_origen, problems AS problemas, documents AS documentacion_estado,
         nullif(array_to_string(missing, ', '), '') AS documentos_faltantes, 'PENDIENTE_REVISION' AS estado
  FROM m)"""
#: A phrase as an origin.
ORIGIN = """CASE phrase WHEN 'Accidente de TRABAJO' THEN 'Accidente de trabajo' WHEN 'enfermedad laboral' THEN 'Laboral' WHEN 'Enfermedad común' THEN 'Común' ELSE phrase END"""
UPDATES = r""",
up AS (
  SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 2 = 0 THEN 'APROBADO' END AS state, CASE WHEN o_orderkey % 6 = 0 THEN 'visto' END AS note,
         'O-1' AS u_order, CAST(o_orderkey % 40 AS INTEGER) AS u_days
  FROM orders WHERE o_orderkey % 3 = 0)"""
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

ORACLES: dict[str, str] = {
    "q01_parse_names": f"WITH {FILES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, name, id_number, doc_type, id_number AS case_id FROM p",
    "q02_name_split_counts": f"""WITH {FILES} SELECT count(*) AS archivos, count(id_number) AS con_nomenclatura,
        count(*) FILTER (id_number IS NULL) AS sin_nomenclatura, count(DISTINCT id_number) AS casos FROM p""",
    "q03_channel": f"""WITH {FILES} SELECT channel, count(*) AS n_files, CASE channel WHEN 'ORIGINAL' THEN 1 WHEN 'WHATSAPP' THEN 2 ELSE 3 END AS code FROM p GROUP BY channel""",
    "q04_cases": f"WITH {CASES} SELECT case_id, array_to_string(present, ',') AS present, n_files, n_base, base, base_type, first_path, channel FROM c",
    "q05_doc_requirements": f"""WITH {CASES} SELECT case_id, type_id, coalesce(array_to_string(missing, ','), '') AS missing,
        CASE WHEN len(missing) = 0 THEN 'COMPLETA' ELSE 'INCOMPLETA' END AS documents FROM k""",
    "q06_required_anti": f"WITH {CASES} SELECT case_id, unnest(missing) AS document FROM k",
    "q07_run_summary": f"""WITH {CASES}, x AS (SELECT len(missing) = 0 AND n_base <= 1 AS good, n_files % 10 = 9 AS failed FROM k)
        SELECT count(*) AS casos_total, count(*) FILTER (good AND NOT failed) AS procesados, count(*) FILTER (NOT good AND NOT failed) AS incompletos,
        count(*) FILTER (failed) AS cuarentena, (SELECT count(*) FROM p WHERE id_number IS NULL) AS sin_nomenclatura FROM x""",
    "q08_canon_doc": f"""WITH {FILES}, t AS (SELECT DISTINCT lower(doc_type) || CASE WHEN l_partkey % 2 = 0 THEN '_1' ELSE '' END AS token FROM p WHERE doc_type IS NOT NULL),
        n AS (SELECT token, CASE WHEN token = 'historia' THEN 'HISTORIA_CLINICA' ELSE replace(upper(token), '1', '') END AS canonical FROM t)
        SELECT token, canonical, CASE WHEN canonical = 'HISTORIA_CLINICA' THEN 'EPICRISIS' ELSE canonical END AS doc_group FROM n""",
    "q10_page_select": f"""WITH x AS (SELECT conv_id AS doc_id, coalesce(
            string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) FILTER (role = 'assistant'),
            string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, ''))) AS t FROM conversations GROUP BY conv_id)
        SELECT doc_id, {STRIP.format('t')} AS text FROM x""",
    "q11_page_cap": """SELECT conv_id, turn, n > 2 AS truncated FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r <= 2""",
    "q12_min_text_guard": f"""SELECT doc_id, length({STRIP.format('text')}) >= 200 AS enough, CASE WHEN length({STRIP.format('text')}) < 200 THEN 'texto insuficiente' END AS note FROM documents""",
    "q13_text_ids": """SELECT doc_id, nullif(regexp_extract(text, '([0-9]{6,16})', 1), '') AS number,
        CASE WHEN strpos(lower(text), 'the') > 0 THEN nullif(regexp_extract(substr(text, strpos(lower(text), 'the') + 3, 30), '([a-z]+)', 1), '') END AS after_the FROM documents""",
    "q14_first_label_value": """SELECT page_id, nullif(regexp_extract(substr(html, strpos(lower(html), '<title>') + 7, 40), '([A-Za-z]+)', 1), '') AS word,
        nullif(regexp_extract(substr(html, strpos(lower(html), 'html lang=') + 10, 20), '"([a-z]+)"', 1), '') AS lang FROM pages""",
    "q15_dates_norm": """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT o_orderkey,
        CASE o_orderkey % 5 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN day(d) || '/' || month(d) || '/' || year(d)
          WHEN 2 THEN strftime(d, '%d-') || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(d)] || strftime(d, '-%y')
          WHEN 3 THEN '31/02/2026' ELSE year(d) || '-13-01' END AS raw,
        CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN make_date(2000 + year(d) % 100, month(d), day(d)) END AS day FROM x)
        SELECT o_orderkey, raw, day, day AS labelled FROM y""",
    "q16_code_candidates": """SELECT p_partkey, 'K' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '.' || (p_partkey % 10) AS best,
        CASE WHEN p_partkey % 2 = 0 THEN 'S' || (p_partkey % 90 + 10) END AS code, [2, 0, 2, 99, 99][p_partkey % 5 + 1] AS fixes FROM part""",
    "q17_deaccent": f"""SELECT doc_id, md5({STRIP.format("regexp_replace(strip_accents(lower(coalesce(text, ''))), '[[:space:]]+', ' ', 'g')")}) AS folded FROM documents""",
    "q18_form_dispatch": """SELECT o_orderkey, o_orderkey % 5 <> 4 AS relevant, CASE o_orderkey % 5 WHEN 0 THEN 'permiso' WHEN 1 THEN 'vacaciones' ELSE 'incapacidad' END AS kind FROM orders""",
    "q20_employee_by_id": f"""WITH {CLAIMS} SELECT claim_id, c_custkey AS emp_id, c_name AS emp_name, n_name AS emp_insurer
        FROM cl LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = person_key LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "q21_employee_by_name": f"""WITH {CLAIMS}, h AS (SELECT claim_id, min(c_custkey) AS id FROM cl JOIN customer
          ON contains(lower(replace(person_name, ' ', '')), lower(replace(c_name, ' ', ''))) GROUP BY claim_id)
        SELECT claim_id, c_custkey AS emp_id, c_name AS emp_name, n_name AS emp_insurer FROM h JOIN customer ON c_custkey = id LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "q22_employee_fallback": f"WITH {MAPPED} SELECT cl.claim_id, coalesce(a.c_custkey, b.c_custkey) AS emp_id, coalesce(a.c_name, b.c_name) AS emp_name FROM cl LEFT JOIN customer a ON CAST(a.c_custkey AS VARCHAR) = person_key LEFT JOIN customer b ON a.c_custkey IS NULL AND b.c_name = substr(person_name, 4)",
    "q23_diagnosis_code": f"WITH {CLAIMS} SELECT claim_id, p_partkey AS dx_id, p_type AS dx_text FROM cl LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = dx_code",
    "q24_insurer_keyword": f"""WITH {CLAIMS}{KEYWORDS} SELECT claim_id, n_nationkey AS ins_id, n_regionkey % 2 + 1 AS ins_kind, n_name AS ins_name
        FROM cl LEFT JOIN kw ON t = insurer_text LEFT JOIN nation ON n_nationkey = id""",
    "q25_insurer_chain": f"WITH {MAPPED} SELECT claim_id, is_traffic, ins_id, ins_kind, ins_name, ins_from_employee, ins_unknown FROM m",
    "q26_type_ladder": f"""WITH {CLAIMS} SELECT claim_id, phrase_type AS type_id, ['', 'ACCIDENTE DE TRABAJO', 'ENFERMEDAD GENERAL', '', 'LICENCIA MATERNIDAD', '', '',
        'ENFERMEDAD LABORAL', 'LICENCIA PATERNIDAD', 'PRELICENCIA', 'TRANSITO NO LABORAL'][phrase_type] AS label FROM cl""",
    "q27_type_precedence": f"""WITH {MAPPED} SELECT claim_id, type_id, label AS type_label, level AS idlpnivelincapacidad,
        CASE level WHEN 2 THEN 'LEVE' WHEN 9 THEN 'NO CRITICA' WHEN 12 THEN 'NO APLICA' WHEN 7 THEN 'NO CALIFICADA' WHEN 13 THEN 'NO APLICA.' WHEN 14 THEN 'NO APLICA..'
          WHEN 11 THEN 'NO CRITICO' END AS level_label FROM m""",
    "q28_requirements_lookup": f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN k % 7 = 1 AND k % 4 = 1 THEN 'INCAPACIDAD,HISTORIA_CLINICA' WHEN k % 7 = 1 AND k % 4 = 0 THEN 'FURAT'
        WHEN k % 7 = 5 AND k % 4 = 0 THEN 'INCAPACIDAD,FURAT' WHEN k % 7 = 2 AND k % 4 = 2 THEN 'CERTIFICADO_NACIDO_VIVO' WHEN k % 7 = 0 AND k % 4 = 3 THEN 'FURIPS,INCAPACIDAD' END AS required FROM cl""",
    "q29_full_enrichment": f"WITH {MAPPED} SELECT claim_id, emp_id, dx_id, ins_id, type_id, missing_text AS missing, documents FROM m",
    "q30_date_reconcile": f'WITH {CLAIMS} SELECT claim_id, s2 AS start, e2 AS "end", CAST(n1 AS INTEGER) AS days, calc AS start_calculated FROM rb',
    "q31_due_date": f"WITH {CLAIMS} SELECT claim_id, CASE WHEN n BETWEEN 1 AND 540 THEN s + n END AS due, coalesce(strftime(s, '%Y/%m/%d'), 'sin_fecha') AS folder FROM cl",
    "q32_days_between": f"""WITH {CLAIMS}, x AS (SELECT *, e + CAST(CASE WHEN k % 3 = 0 THEN 540 ELSE 0 END AS INTEGER) - s + 1 AS b FROM cl)
        SELECT claim_id, CASE WHEN b BETWEEN 1 AND 540 THEN b END AS days_between, n BETWEEN 1 AND 540 AS days_ok FROM x""",
    "q33_completeness": f"WITH {MAPPED} SELECT claim_id, CAST(share AS DOUBLE) AS share FROM m",
    "q34_problems": f"WITH {MAPPED} SELECT claim_id, problems AS problemas, fields, problems IS NOT NULL AS needs_review FROM m",
    "q35_observations": f"WITH {MAPPED} SELECT claim_id, notes AS observaciones, person AS paciente_leido FROM m",
    "q36_staging_rows": f"WITH {MAPPED} SELECT * EXCLUDE (id, channel) FROM st",
    "q40_merge_records": f"""WITH {CLAIMS}, x AS (SELECT *, k % 7 = 1 OR kind = 'permiso' AS alone FROM cl) SELECT claim_id,
        CASE WHEN NOT alone AND k % 3 <> 0 THEN 'Modelo' ELSE person_name END AS nombre, CASE WHEN alone THEN person_key ELSE coalesce(person_key, '999') END AS documento_numero,
        CASE WHEN NOT alone AND NOT anchored AND k % 4 = 0 THEN s + 1 ELSE s END AS start, e AS "end",
        CASE WHEN NOT alone AND k % 8 = 0 AND NOT (anchored AND n IS NOT NULL) THEN 4 ELSE n END AS days,
        CASE WHEN alone THEN phrase WHEN k % 5 = 1 THEN 'Laboral' ELSE {ORIGIN} END AS origin, dx_code AS cie10 FROM x""",
    "q41_origin_clean": f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN k % 9 IN (0, 1) THEN NULL ELSE {ORIGIN} END AS origin,
        CASE WHEN k % 2 = 0 THEN 'PARTO NO VIABLE' ELSE 'Otra' END AS licence FROM cl""",
    "q42_json_rescue": """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 4 = 3 AS failed FROM events""",
    "q50_staging_topk": f'WITH {MAPPED} SELECT id, estado, fechainicio, "Numerodias", idlpempleado, problemas FROM st ORDER BY id DESC LIMIT 20',
    "q51_review_apply": f"""WITH {MAPPED}{UPDATES} SELECT id, coalesce(state, estado) AS estado, u_order AS numeroorden, CASE WHEN uid IS NOT NULL THEN u_days ELSE "Numerodias" END AS "Numerodias",
        CASE WHEN note IS NOT NULL THEN left(trim(coalesce(observaciones, '') || ' | ' || note, ' |'), 65000) ELSE observaciones END AS observaciones FROM st LEFT JOIN up ON uid = id""",
    "q52_state_update": f"""WITH {MAPPED}{UPDATES} SELECT id, coalesce(state, estado) AS estado, "Numerodias",
        CASE WHEN note IS NOT NULL THEN left(coalesce(observaciones, '') || ' | ' || note, 65000) ELSE observaciones END AS observaciones FROM st LEFT JOIN up ON uid = id""",
    "q53_quick_approval": f"""WITH {MAPPED}, q AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey ELSE o_orderkey END AS rid,
          ['aprobar', 'rechazar', 'guardar', 'otra'][o_orderkey % 4 + 1] AS action, o_orderkey % 8 < 2 AS has_body FROM orders),
        l AS (SELECT id, problemas, concat_ws(',', CASE WHEN coalesce(idlpempleado, 0) = 0 THEN 'empleado' END, CASE WHEN coalesce(idlpdiagnosticos, 0) = 0 THEN 'diagnóstico' END,
          CASE WHEN fechainicio IS NULL THEN 'fecha de inicio' END, CASE WHEN coalesce("Numerodias", 0) = 0 THEN 'días' END) AS lacking FROM st),
        z AS (SELECT rid, action, lacking, CASE WHEN action = 'otra' OR (action = 'guardar' AND NOT has_body) THEN 400 WHEN id IS NULL THEN 404
          WHEN action = 'aprobar' AND CASE WHEN has_body THEN problemas IS NOT NULL ELSE lacking <> '' END THEN 409 ELSE 200 END AS code FROM q LEFT JOIN l ON id = rid)
        SELECT rid AS id, action, code, CASE WHEN code = 200 THEN CASE action WHEN 'aprobar' THEN 'APROBADO' WHEN 'rechazar' THEN 'RECHAZADO' ELSE 'PENDIENTE_REVISION' END END AS state, lacking FROM z""",
    "q54_alerts": f"""WITH {MAPPED} SELECT id AS id_ausentismo_ia, idlpempleado, CAST(claim_id AS VARCHAR) AS cedula, idlpentidad, eps_leida AS eps, documentos_faltantes,
        'Faltan soportes para el ausentismo del empleado ' || claim_id || ': ' || documentos_faltantes || '.' AS mensaje, channel AS canal, 'PENDIENTE' AS estado
        FROM st WHERE documentacion_estado = 'INCOMPLETA'""",
    "q55_catalog_upsert": """SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'UNO BIS' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 90, 'NOVENTA'""",
    "q56_routing_manifest": f"""WITH {FILES}, x AS (SELECT p.*, l_orderkey AS k, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS s FROM p LEFT JOIN orders ON o_orderkey = l_orderkey),
        y AS (SELECT *, CASE WHEN id_number IS NULL THEN 'inbox/sin_nomenclatura' WHEN k % 29 = 0 THEN 'cuarentena/' || id_number
          ELSE CASE WHEN k % 2 = 0 THEN 'procesados' ELSE 'incompletos' END || '/' || CASE WHEN k % 3 <> 0 THEN 'Alix Perez' ELSE 'SIN NOMBRE ' || id_number END || '/' || coalesce(strftime(s, '%Y/%m/%d'), 'sin_fecha') END
          || '/' || name AS dest FROM x)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dest, count(*) OVER (PARTITION BY dest) > 1 AS collision FROM y""",
    "q57_batch_cap": f"WITH {CASES} SELECT case_id, first_path, n_files FROM c ORDER BY first_path, case_id LIMIT 500",
    "q60_accuracy": """WITH x AS (SELECT lang, CASE WHEN quality IS NOT NULL THEN CAST(length(text) > 1000 AS INTEGER) = quality END AS a,
          CASE WHEN toxic = 1 THEN length(regexp_replace(text, '[^,]', '', 'g')) % 3 IN (1, 2) END AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
        y AS (SELECT * FROM x UNION ALL SELECT 'all', a, b FROM x),
        z AS (SELECT lang, sum(coalesce(CAST(a AS INTEGER), 0) + coalesce(CAST(b AS INTEGER), 0)) AS hits, sum(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER)) AS scored FROM y GROUP BY lang)
        SELECT lang, CAST(hits AS BIGINT) AS hits, CAST(scored AS BIGINT) AS scored, CASE WHEN scored > 0 THEN round(100.0 * hits / scored, 0) END AS percent FROM z""",
    "q63_containment_large": f"""WITH {CLAIMS} SELECT claim_id, min(c_custkey) AS emp_id FROM cl JOIN customer ON contains(lower(replace(person_name, ' ', '')), lower(c_name)) GROUP BY claim_id""",
    "q64_new_rows": f"WITH {CASES} SELECT case_id, n_files FROM c WHERE n_files % 2 = 1",
    "q65_json_rows": f"""WITH {CLAIMS} SELECT CAST(to_json({{'claim_id': claim_id, 'start': strftime(s, '%Y-%m-%d'), 'days': n, 'dx_code': dx_code, 'phrase': phrase}}) AS VARCHAR) AS value FROM cl""",
    "q66_without_catalogue": f"""WITH {CLAIMS} SELECT claim_id, false AS there, CAST(NULL AS INTEGER) AS emp_id, CAST(NULL AS INTEGER) AS dx_id,
        CASE WHEN kind = 'incapacidad' THEN 1 END AS ins_id, coalesce(person_name, '?') AS name FROM cl""",
    "q67_point_lookup": f"WITH {MAPPED} SELECT id, estado, idlptipoausentismo, cedula_leida FROM st WHERE id = 42",
    "q68_label_tables": """SELECT unnest([2, 3, 5, 7, 8, 9, 10, 11, 12, 13]) AS code, unnest(['ACCIDENTE DE TRABAJO', 'ENFERMEDAD GENERAL', 'LICENCIA MATERNIDAD', 'LICENCIA NO REMUNERADA',
          'ENFERMEDAD LABORAL', 'LICENCIA PATERNIDAD', 'PRELICENCIA', 'TRANSITO NO LABORAL', 'LICENCIA REMUNERADA', 'VACACIONES']) AS label, 'lptipoausentismo' AS kind
        UNION ALL SELECT unnest(range(1, 15)), unnest(['INDEFINIDO', 'LEVE', 'SEVERO', 'GRAVE', 'MORTAL', 'CALIFICADA', 'NO CALIFICADA', 'CRITICA', 'NO CRITICA', 'CRITICO',
          'NO CRITICO', 'NO APLICA', 'NO APLICA.', 'NO APLICA..']), 'lpnivelincapacidad'
        UNION ALL SELECT unnest([1, 2, 3]), unnest(['ORIGINAL', 'WHATSAPP', 'CORREO']), 'lpestadosrecepausentismos'""",
    "q69_page_sizes": """WITH x AS (SELECT p_partkey, CAST(p_partkey % 97 * 150 + 100 AS INTEGER) AS w, CAST(p_partkey % 89 * 140 + 50 AS INTEGER) AS h, p_partkey * 7001 % 70000000 AS size FROM part)
        SELECT p_partkey, true AS fits, CASE WHEN p_partkey % 5 = 0 THEN 415 WHEN size > 52428800 THEN 413 WHEN size = 0 THEN 400 END AS refused,
        CASE WHEN w::BIGINT * h <= 40000000 THEN w ELSE greatest(1, CAST(floor(w * sqrt(40000000 / (w::BIGINT * h))) AS INTEGER)) END AS width FROM x""",
    "q70_certificates": """WITH o AS (SELECT *, o_orderkey % 6 AS v, o_orderkey % 11 = 0 AS bare, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 10 + 1 AS INTEGER) AS n,
          chr(CAST(o_orderkey % 26 + 65 AS INTEGER)) || (o_orderkey % 90 + 10) || '.' || (o_orderkey % 10) AS c FROM orders)
        SELECT o_orderkey, 'incapacidad' AS kind, 'CC' AS id_kind, CAST(o_orderkey + 70000000 AS VARCHAR) AS id_number,
        ['LUZ', 'ANA', 'PEDRO', 'MARINA', 'OLMO'][o_orderkey % 5 + 1] || ' ' || ['PRADERA', 'SOLAR', 'FARO', 'ONDA'][o_orderkey % 4 + 1] AS name,
        CASE WHEN v IN (0, 2, 4) THEN 'SOLNORTE' WHEN v = 1 THEN 'SALUD DEL LAGO' WHEN v = 5 THEN 'SALUD MAR' END AS insurer,
        CASE v WHEN 0 THEN 'CLINICA DEL FARO ' || (o_orderkey % 7) WHEN 5 THEN 'Afiliado: CLINICA DEL LAGO' END AS provider,
        CASE WHEN v < 2 THEN d - 1 END AS issued, d AS first, CAST(d + (n - 1) AS DATE) AS last, n AS days,
        CASE v WHEN 0 THEN 'Ambulatoria' WHEN 5 THEN 'Hospitalaria' END AS type,
        CASE v WHEN 0 THEN 'Enfermedad general' WHEN 1 THEN 'Común' WHEN 2 THEN 'ACCIDENTE DE TRANSITO' WHEN 5 THEN 'Laboral' END AS origin,
        CASE WHEN v = 5 THEN 'PARTO NO VIABLE' END AS licence, v IN (2, 3, 4) AS anchored, CASE WHEN v = 2 OR NOT bare THEN c END AS code,
        CASE WHEN v = 2 THEN 'FRACTURA DE PRUEBA' WHEN bare THEN NULL WHEN v IN (0, 4) THEN 'Hernia de prueba' WHEN v = 1 THEN 'HERNIA' WHEN v = 3 THEN 'Lumbago' ELSE 'ROTURA' END AS diagnosis,
        CASE WHEN v < 2 THEN 'PEDRA MARINA SOLAR' END AS doctor, CASE WHEN v < 2 THEN CAST(o_orderkey + 55000 AS VARCHAR) END AS register FROM o""",
    "q71_holiday_letters": """WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS two, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 10 + 1 AS INTEGER) AS n FROM orders)
        SELECT o_orderkey, 'vacaciones' AS kind, CAST(o_orderkey + 70000000 AS VARCHAR) AS id_number,
        ['LUZ', 'ANA', 'PEDRO', 'MARINA', 'OLMO'][o_orderkey % 5 + 1] || ' ' || ['PRADERA', 'SOLAR', 'FARO', 'ONDA'][o_orderkey % 4 + 1] AS name,
        d AS first, CAST(d + (n - 1) + CASE WHEN two THEN 5 ELSE 0 END AS DATE) AS last, n + CASE WHEN two THEN 5 ELSE 0 END AS days FROM o""",
    "q72_permits": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS v, o_orderkey % 3 + 1 AS w, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 10 + 1 AS INTEGER) AS n FROM orders)
        SELECT k AS o_orderkey, 'permiso' AS kind, CAST(k + 80000000 AS VARCHAR) AS id_number, ['Marta Luna Clara', 'Jorge Faro', 'Olga Prado Rey Mar'][w] AS name, d AS first,
        CASE WHEN v = 2 THEN d ELSE CAST(d + (n - 1) AS DATE) END AS last, CASE WHEN v = 2 THEN 1 ELSE n END AS days,
        ['LICENCIA REMUNERADA', 'LICENCIA NO REMUNERADA', NULL][w] AS type, CASE WHEN v = 3 THEN 'Fecha' ELSE ['Lacteos de Norte', 'Faro', 'Casa del Mar y Sol'][w] END AS company,
        'Analista' AS post, d - 2 AS asked, ['REMUNERADO', 'NO_REMUNERADO', NULL][w] AS paid, 'Cita en notaria ' || (k % 9) AS detail,
        CASE WHEN k % 2 = 0 THEN '8:00 a.m.' END AS hour_from, CASE WHEN k % 2 = 0 THEN '10:30' END AS hour_to, CAST(k % 5 + 1 AS VARCHAR) AS hours,
        'Jorge Faro Alto' AS approver, 'Gerente' AS approver_post FROM o""",
    "q73_names_contained": """WITH x AS (SELECT c_custkey, c_name, lower(c_name) AS key, split_part(c_name, '#', 2) AS digits FROM customer),
        r AS (SELECT c_custkey * 5 + way AS read_id,
          CASE way WHEN 0 THEN 'sra.' || key || 's.' WHEN 1 THEN 'r#' || digits WHEN 2 THEN right(digits, 5) WHEN 3 THEN left(key, 14) ELSE key END AS t
          FROM x, (SELECT unnest(range(5)) AS way)),
        h AS (SELECT read_id, min(c_custkey) AS emp_id FROM (SELECT DISTINCT t FROM r WHERE length(t) >= 8) JOIN x ON contains(t, key) OR contains(key, t) JOIN r USING (t) GROUP BY read_id)
        SELECT read_id, emp_id, c_name AS emp_name FROM h JOIN customer ON c_custkey = emp_id""",
    "q61_wordbreak": """SELECT p_partkey, CASE WHEN length(replace(p_name, ' ', '')) >= 9 THEN upper(p_name) ELSE upper(replace(p_name, ' ', '')) END AS parts, p_name AS short FROM part""",
    "q62_stub_ocr_pipeline": f"""WITH x AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 30 GROUP BY conv_id)
        SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(length({STRIP.format('t')}) AS INTEGER) AS n_chars, 'incapacidad' AS tipo_documento, CAST(NULL AS VARCHAR) AS documento_numero,
        CASE WHEN length({STRIP.format('t')}) < 10 THEN 'texto insuficiente' END AS note, CAST(NULL AS VARCHAR) AS error FROM x""",
    "q74_requirement_seeds": """SELECT unnest(range(1, 13))::INTEGER AS id, unnest([1, 1, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7]) AS idlpentidad, unnest([3, 3, 3, 3, 3, 3, 3, 3, 2, 2, 2, 2]) AS idlptipoausentismo,
        unnest(['INCAPACIDAD', 'EPICRISIS', 'INCAPACIDAD', 'HISTORIA_CLINICA', 'INCAPACIDAD', 'HISTORIA_CLINICA', 'INCAPACIDAD', 'HISTORIA_CLINICA', 'INCAPACIDAD', 'FURAT', 'INCAPACIDAD', 'FURAT']) AS documento, true AS obligatorio""",
    "q75_case_problems": """SELECT CAST(o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 60000000 ELSE 80000000 END AS VARCHAR) AS case_id,
        CAST(o_orderkey + CASE WHEN o_orderkey % 7 = 3 AND o_orderkey % 5 = 0 THEN 60000000 ELSE 80000000 END AS VARCHAR) AS number,
        o_orderkey % 5 = 0 AND o_orderkey % 7 <> 3 AS clash, o_orderkey % 4 = 1 AS many, o_orderkey % 50 = 7 AS failed,
        CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS n_base, 3 AS idlpestadosrecepausentismos FROM orders""",
    "q76_text_functions": """SELECT o_orderkey, 'Analista ' || (o_orderkey % 9) || '|Gerente ' || (o_orderkey % 7) AS posts, 'Ána Núñez Güell' AS name, 'ANA NUNEZ GUELL' AS plain,
        CAST(o_orderdate AS DATE) AS asked, CAST(NULL AS DATE) AS others, CAST(o_orderdate AS DATE) AS before, round((o_orderkey % 50) / 4.0, 1)::DOUBLE AS mb FROM orders""",
    "q77_corrections": """SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_cedula, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 30 AS VARCHAR) END AS o_dias,
        CASE WHEN o_orderkey % 4 = 1 THEN 'O-9' END AS o_numeroorden, CAST(NULL AS VARCHAR) AS o_tipo FROM orders""",
    "q78_register": f"""WITH {MAPPED} SELECT claim_id, CASE WHEN claim_id % 5 = 0 AND problemas IS NOT NULL THEN 409 ELSE 200 END AS code,
        CASE WHEN claim_id % 5 = 0 AND problemas IS NULL THEN 'APROBADO' WHEN claim_id % 5 IN (1, 2) THEN 'RECHAZADO' ELSE 'PENDIENTE_REVISION' END AS estado,
        CASE WHEN claim_id % 5 = 1 THEN CASE WHEN coalesce(observaciones, '') = '' THEN '' ELSE observaciones || ' | ' END || 'RECHAZADO: ilegible' ELSE observaciones END AS observaciones FROM st""",
    "q79_insurer_large": """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'epscustomer#' || lpad(o_custkey::VARCHAR, 9, '0') || 's.a.'
          WHEN 1 THEN 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 2 THEN 'otraentidad' END AS said FROM orders),
        h AS (SELECT said, min(c_custkey) AS id FROM (SELECT DISTINCT said FROM t WHERE said IS NOT NULL) JOIN customer ON contains(said, lower(c_name)) GROUP BY said)
        SELECT o_orderkey, CAST(id AS INTEGER) AS ins_id, CAST(c_nationkey % 2 + 1 AS INTEGER) AS ins_kind, c_name AS ins_name FROM t LEFT JOIN h USING (said) LEFT JOIN customer ON c_custkey = id""",
}
