"""The fields of network objects, and the words that speak for or against a column or a table."""

from __future__ import annotations

# Aliases of fields in inventory exports; ``!`` marks required fields and ``#`` those that hold figures.
COMMON = {
    "id": "id codigo fid", "name": "name nombre", "from_bus": "from_bus nodo_i bus1", "to_bus": "to_bus nodo_f bus2", "bus_id": "bus_id nodo barra",
    "nominal_voltage_kv": "nominal_voltage_kv voltage_kv tension voltaje kv", "x": "x este east", "y": "y norte north",
    "active_power_mw": "active_power_mw p_mw p potencia", "reactive_power_mvar": "reactive_power_mvar q_mvar q",
    "in_service": "in_service estadoinstalacion estado", "type_id": "type_id tipo",
}
FIELDS = {
    "buses": {
        "id!": "code objectid cod_nodo codnodo", "nominal_voltage_kv!#": "uknom voltage codtennomi tennomi tennom niveldetensionkv tensionnominalmtkv tensionnominalbtkv niveldetension",
        "x#": "lon longitude utmeste utme", "y#": "lat latitude utmnorte utmn", "name": "loc_name descripcion etiqueta",
    },
    "lines": {
        "id!": "code cod_tramo codtramo codtramobt codtramomt", "name": "loc_name",
        "from_bus!": "from origen node_from codnodo nodo_origen padre codtramobtpadre codtramomtpadre tramopadre codigotramopadre", "to_bus!": "to destino node_to codnodo",
        "length_km!#": "length_km length longitud long_km dline longitudrealm longitudreal", "nominal_voltage_kv!#": "voltage codtennomi tennomi niveldetensionkv niveldetension",
        "type_id": "conductor cod_cond codnorma norma codnormafase codigonormafase combinaciondelcable", "in_service": "outserv",
    },
    "loads": {
        "id!": "code nis", "name": "nombredelcliente", "bus_id!": "bus acometida sed tramobt salida", "active_power_mw!#": "pac dmax kw demanda", "reactive_power_mvar#": "kvar kvarh", "in_service": "estadodelsuminsitro",
    },
    "sources": {"id!": "code", "name": "alimentador", "bus_id!": "bus conexionn set sed", "nominal_voltage_kv!#": "", "in_service": ""},
    "transformers": {
        "id!": "codigodeequipo", "name": "codigodeequipo", "hv_bus!": "hv_bus nodo_at bus_hv alta sed", "lv_bus!": "lv_bus nodo_bt bus_lv baja sed",
        "hv_voltage_kv!#": "hv_voltage_kv tension_at uhv niveldetensionprimariakv niveldetensionprimaria", "lv_voltage_kv!#": "lv_voltage_kv tension_bt ulv niveldetensionsecundariakv niveldetensionsecundaria",
        "rated_power_mva!#": "rated_power_mva s_mva potencia snom potenciainstaladakva capacidad", "type_id": "modelo",
    },
    "switches": {"id!": "", "name": "", "from_bus!": "", "to_bus!": "", "closed": "closed cerrado on_off estado"},
    "generators": {"id!": "", "name": "", "bus_id!": "", "active_power_mw!#": "", "reactive_power_mvar#": "", "technology": "technology tecnologia tipo"},
    "substations": {"id!": "codset", "name": "", "x#": "", "y#": ""},
}
# Names of tables.
TABLES = {
    "buses": "bus buses barra barras nodo nodos node nodes busbar nodoenlace enlace punto puntoconexion estructura estructuras structure structures poste postes sed set subestacion",
    "lines": "line lines linea lineas tramo tramos conductor span tramobt tramomt tramoat equipo equipos equipment eqpm segmento segment",
    "loads": "load loads carga cargas consumo suministro suministros acometida acometidas",
    "sources": "source sources fuente fuentes grid alimentad alimentador feeder salida salidamt salidaat salidabt amt",
    "transformers": "transformer transformers trafo trafos transformador transformadordistribucion",
    "switches": "switch switches seccionador interruptor breaker equipodeproteccion proteccion",
    "generators": "generator generators generador generacion der pv",
    "substations": "substation substations subestacion set estacion",
}

ENDS = "from_bus to_bus bus_id hv_bus lv_bus"
_PLACES = "distrito|district|jerarquia|localidad|ubicacion|direccion|address|provincia|departamento|zona|color|rol|estado|fec|descripcion|description|observacion|telefono|voltaje|tension"
_AXES = "x|y|este|east|norte|north|coord|geometr|utm|lon|lat"
_OWNERS = "propietar|proprietar|owner|titular|mantenedor|ejecutor|rol|color|localidad|distrito|sistema|descripcion|description|nombre|name|codigo|code"
_STATES = "estado|servic|outserv|activo|inactiv|operativ|status|instalacion|suministro"
_WHEN = "fec|date|timestamp"
# Fields, slot, what a column's token holds, what it lacks, whether the column holds dates, factor, bonus.
# Of the rules of a slot the first that applies counts.
RULES = (
    (ENDS, "place", _PLACES, "", False, 0.05, 0.0),
    (ENDS, "make", "fase|phase|norma|conductor|calibre", "", False, 0.10, 0.0),
    (ENDS, "date", "", "", True, 0.05, 0.0),
    ("from_bus to_bus", "segment", "tramo|segment|line|conductor", "padre|parent|nodo|bus|origen|destino|from|to|salid", False, 0.20, 0.0),
    ("from_bus", "own", "tramo$", "padre|parent", False, 0.20, 0.0),
    ("x y", "axis", "", _AXES, False, 0.05, 0.0),
    ("x y", "axis", "^(cantfases?|fase|fasesqtd)$", "", False, 0.02, 0.0),
    ("x y", "axis", "voltaje|tension", "", False, 0.05, 0.0),
    ("nominal_voltage_kv", "text", "^(descripcion|description|nombre|name)$", "", False, 0.02, 0.0),
    ("nominal_voltage_kv", "unit", "kv", "", False, 1.0, 0.12),
    ("type_id", "type", "tipored|tipocircuito|tiposervicio|tiposistema", "", False, 0.25, 0.0),
    ("type_id", "type", "norma|conductor", "", False, 1.0, 0.15),
    ("type_id", "type", "^(codigo|code|id|fid)$", "", False, 0.15, 0.0),
    ("in_service", "date", "", "", True, 0.05, 0.0),
    ("in_service", "when", _WHEN + "|existe|desde|puesta|commission", "", False, 0.05, 0.0),
    ("in_service", "state", _OWNERS, "", False, 0.05, 0.0),
    ("in_service", "state", "", _STATES, False, 0.25, 0.0),
    ("name", "date", "", "", True, 0.05, 0.0),
    ("name", "kind", "padre|parent$", "", False, 0.05, 0.0),
    ("name", "kind", "frombus|tobus|bus1|origen|destino", "", False, 0.10, 0.0),
    ("name", "kind", "^(phase|fase)$", "", False, 0.05, 0.0),
    ("name", "kind", _WHEN, "", False, 0.05, 0.0),
    ("name", "kind", "norma", "", False, 0.10, 0.0),
)
# Words of tables that hold no buses, and none of substations.
NO_BUSES = "generacion|generador|generator"
NO_SUBSTATIONS = "section|tramo|segment|line|carga|load|customer|node|nodo"
# Weights of the objectives of a mapping.
WEIGHTS = {"coverage": 0.28, "lexical": 0.18, "types": 0.16, "uniqueness": 0.12, "connectivity": 0.16, "compactness": 0.10}


def field_rows() -> list[tuple[str, str, bool, bool]]:
    """(entity, field, required, numeric) of all fields."""
    return [(e, f.strip("!#"), "!" in f, "#" in f) for e, fs in FIELDS.items() for f in fs]


def alias_rows() -> list[tuple[str, str, str]]:
    """(entity, field, alias): a field's aliases everywhere and those of one entity."""
    return [(e, f.strip("!#"), a) for e, fs in FIELDS.items() for f, own in fs.items() for a in f"{COMMON.get(f.strip('!#'), '')} {own}".split()]


def table_rows() -> list[tuple[str, str]]:
    return [(e, a) for e, names in TABLES.items() for a in names.split()]


def rule_rows() -> list[tuple[str, str, int, str, str, bool, float, float]]:
    """(field, slot, nr, holds, lacks, dated, factor, plus), a row for each field of a rule."""
    return [(f, slot, i, *rest) for i, (fields, slot, *rest) in enumerate(RULES) for f in fields.split()]
