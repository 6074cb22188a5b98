"""Extraction of certificates, holiday letters and permission slips from invented texts."""

from datetime import date

import pytest

from foliospark.plans.pipeline import extract, rule_extractor

CERTIFICATE = """EPS SOLNORTE
CERTIFICADO DE INCAPACIDAD MEDICA

Paciente: LUZ PRADERA ONDA
Documento: CC 90012345
IPS: CLINICA DEL FARO
Fecha expedición: 2031-02-03

Incapacidad desde 2031-02-04 hasta 2031-02-08
Días de incapacidad: 5

Diagnóstico: K42.9 Hernia de prueba
Tipo de incapacidad: Ambulatoria
Origen: Enfermedad general
Médico: PEDRA MARINA SOLAR R
Registro: RM 55123
"""
HOLIDAY = """NOTIFICACION PERIODO DE VACACIONES
Señora ROSA MENTA VERDE, CC: 70055511
disfrutará a partir del veintinueve (29) de mayo de dos mil treinta y uno (2031)
y hasta el doce (12) de junio de dos mil treinta y uno (2031), cuando vuelve el dia siete (07) de julio.
"""
PERMIT = """FORMATO SOLICITUD DE PERMISO
1. DATOS DE LA SOLICITUD
03/04/2031 Marta Luna Clara 80077001 Lacteos de Norte
2. TIPO DE PERMISO
X Remunerado   No Remunerado
DETALLE: Cita en notaria

DURACION DEL PERMISO
Desde Hasta
04/04/2031
05/04/2031
APROBACION DE LA SOLICITUD
SOLICITADO POR AUTORIZADO POR
CARGO: Analista
CARGO: Gerente
NOMBRE
Marta Luna Clara
NOMBRE
Jorge Faro Alto
"""
DETAIL = """DETALLE DE LA INCAPACIDAD CAUSA EXTERNA DIAGNOSTICO DIAS INC. INICIO FINALIZACION
ACCIDENTE_DE_TRANSITO
S420 FRACTURA DE PRUEBA
10
01/03/2031
10/03/2031
CC 80011122
"""


@pytest.fixture(scope="module")
def records(spark):
    data = [("a", CERTIFICATE), ("b", HOLIDAY), ("c", PERMIT), ("d", DETAIL), ("e", "corto"), ("f", None)]
    done = extract(spark.createDataFrame(data, "id string, text string"), rule_extractor())
    return {r["id"]: r for r in done.collect()}


def test_certificate(records):
    r = records["a"]["record"]
    assert r["tipo_documento"] == "incapacidad"
    assert (r["paciente"]["nombre"], r["paciente"]["documento_tipo"], r["paciente"]["documento_numero"]) == ("LUZ PRADERA ONDA", "CC", "90012345")
    assert (r["entidad"]["eps"], r["entidad"]["ips_prestador"]) == ("SOLNORTE", "CLINICA DEL FARO")
    i = r["incapacidad"]
    assert (i["fecha_inicio"], i["fecha_fin"], i["dias"], i["fecha_expedicion"]) == (date(2031, 2, 4), date(2031, 2, 8), 5, date(2031, 2, 3))
    assert (i["tipo"], i["origen"]) == ("Ambulatoria", "Enfermedad general")
    assert (r["diagnostico"]["cie10"], r["diagnostico"]["descripcion"]) == ("K42.9", "Hernia de prueba")
    assert r["medico"]["nombre"] == "PEDRA MARINA SOLAR"
    assert r["medico"]["registro"] == "55123"


def test_holiday_letter(records):
    r = records["b"]["record"]
    assert r["tipo_documento"] == "vacaciones"
    assert r["paciente"]["documento_numero"] == "70055511"
    i = r["incapacidad"]
    assert (i["fecha_inicio"], i["fecha_fin"], i["dias"]) == (date(2031, 5, 29), date(2031, 6, 12), 15)


def test_permit(records):
    r = records["c"]["record"]
    assert r["tipo_documento"] == "permiso"
    assert (r["paciente"]["nombre"], r["paciente"]["documento_numero"]) == ("Marta Luna Clara", "80077001")
    p = r["permiso"]
    assert (p["empresa"], p["tipo_remunerado"], p["fecha_solicitud"]) == ("Lacteos de Norte", "REMUNERADO", date(2031, 4, 3))
    assert (p["cargo"], p["autorizado_cargo"], p["autorizado_por"]) == ("Analista", "Gerente", "Jorge Faro Alto")
    assert p["detalle"] == "Cita en notaria"
    assert (r["incapacidad"]["fecha_inicio"], r["incapacidad"]["fecha_fin"], r["incapacidad"]["dias"]) == (date(2031, 4, 4), date(2031, 4, 5), 2)
    assert r["incapacidad"]["tipo"] == "LICENCIA REMUNERADA"


def test_detail_table_overwrites(records):
    r = records["d"]["record"]
    assert (r["diagnostico"]["cie10"], r["diagnostico"]["descripcion"]) == ("S42.0", "FRACTURA DE PRUEBA")
    assert r["incapacidad"]["origen"] == "ACCIDENTE DE TRANSITO"
    assert (r["incapacidad"]["fecha_inicio"], r["incapacidad"]["fecha_fin"], r["incapacidad"]["dias"]) == (date(2031, 3, 1), date(2031, 3, 10), 10)


def test_short_texts_are_not_extracted(records):
    for key in "ef":
        assert records[key]["note"]
        assert records[key]["record"]["paciente"]["documento_numero"] is None
    assert records["a"]["note"] is None
