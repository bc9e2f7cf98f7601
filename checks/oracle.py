"""Check queries for DuckDB, one per registered query.

Each is written against the retail tables as plainly as possible, join first
and group after, and so follows another path than the Spark job it checks.
"""

from __future__ import annotations

from ledgerloom.model.labels import RULE_VIEWS, SCOREBOARD
from ledgerloom.model.schema import TABLES
from ledgerloom.sources import starschema as star

_LINES = (
    "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"
)
_CATALOGUE = "(SELECT * FROM part, (VALUES (1), (2)) b(filial_id))"
_RECEIPTS = "lineitem"

_SOURCES = {
    "supplier": ("supplier", star.SUPPLIER, star.RAW_SUPPLIER),
    "branch_product": (_CATALOGUE, star.BRANCH_PRODUCT, star.RAW_BRANCH_PRODUCT),
    "purchase_order": (_LINES, star.PURCHASE_ORDER, star.RAW_PURCHASE_ORDER),
    "goods_receipt": (_RECEIPTS, star.GOODS_RECEIPT, star.RAW_GOODS_RECEIPT),
    "sales": (_LINES, star.SALES, star.RAW_SALES),
}
# Short names of the retail tables inside the check queries.
_ALIAS = {
    "supplier": "forn", "branch_product": "cat", "purchase_order": "ped",
    "goods_receipt": "ent", "sales": "ven",
}


def _select(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(star.projection(columns))} FROM {source}"


_CTES: dict[str, str] = {}
for _name, (_source, _typed, _raw) in _SOURCES.items():
    _CTES[_ALIAS[_name]] = _select(_typed, _source)
    _CTES["r_" + _ALIAS[_name]] = _select(_raw, _source)
_CTES["dia"] = "SELECT CAST(unnest(generate_series(DATE '1997-02-01', DATE '1997-02-28', INTERVAL 1 DAY)) AS DATE) AS d"
_CTES["sheet"] = _select(star.ORDER_SHEET, _LINES)
_CTES["mud"] = _select(
    star.CHANGES,
    "(SELECT part.*, 0 AS turn FROM part UNION ALL SELECT part.*, 1 FROM part WHERE p_partkey % 30 = 0)",
)


def _whole(expr: str, dtype: str) -> str:
    return f"TRY_CAST(round(TRY_CAST(trim({expr}) AS DECIMAL(38,10))) AS {dtype})"


def _dec(expr: str, dtype: str) -> str:
    return f"TRY_CAST(trim({expr}) AS {dtype})"


def _blank(expr: str) -> str:
    return f"nullif(trim({expr}), '')"


_QTY, _PRICE = "DECIMAL(14,3)", "DECIMAL(12,4)"


def _bad(expr: str, value: str) -> str:
    return f"({_blank(expr)} IS NOT NULL AND {value} IS NULL)"


# Per raw table its key and what must be readable in it.
_READABLE: dict[str, tuple[str, list[tuple[str, str]]]] = {}


def _loaded(raw: str, key: str, columns: dict[str, str], readable: list[tuple[str, str]]) -> str:
    _READABLE[raw] = key, readable
    bad = " OR ".join(_bad(c, v) for c, v in readable) or "false"
    body = ", ".join(f"{v} AS {c}" for c, v in columns.items())
    return f"SELECT {body} FROM {raw} WHERE {_blank(key)} IS NOT NULL AND NOT ({bad})"


def _pick(columns: dict[str, str], *names: str) -> list[tuple[str, str]]:
    return [(n, columns[n]) for n in names]


_CLOCK = (
    "CASE WHEN trim({0}) SIMILAR TO '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]' THEN trim({0}) END"
)

_l_forn = {
    "idfornecedor": "trim(idfornecedor)",
    "fornecedor_num": r"TRY_CAST(nullif(regexp_replace(idfornecedor, '[^0-9]', '', 'g'), '') AS INT)",
    "razao_social": "trim(razao_social)",
}
_CTES["l_forn"] = _loaded("r_forn", "idfornecedor", _l_forn, [])

_l_cat = {
    "filial_id": _whole("filial_id", "INT"),
    "idproduto": "trim(idproduto)",
    "descricao": "trim(descricao)",
    "estoque": _dec("estoque", _QTY),
    "preco_unitario": _dec("preco_unitario", _PRICE),
    "preco_compra": _dec("preco_compra", _PRICE),
    "preco_venda": _dec("preco_venda", _PRICE),
    "idfornecedor": _blank("idfornecedor"),
    "idfornecedor_num": "CAST(NULL AS INT)",
}
_CTES["l_cat"] = _loaded(
    "r_cat", "idproduto", _l_cat,
    _pick(_l_cat, "filial_id", "estoque", "preco_unitario", "preco_compra", "preco_venda"),
)

_ped_read = {
    "ordem_compra": _whole("ordem_compra", "BIGINT"),
    "qtde_entregue": _dec("qtde_entregue", _QTY),
}
_l_ped = {
    "pedido_id": _whole("pedido_id", "BIGINT"),
    "item": _whole("item", "INT"),
    "ordem_compra": f"coalesce({_ped_read['ordem_compra']}, 0)",
    "data_pedido": f"TRY_CAST({_blank('data_pedido')} AS DATE)",
    "produto_id": "trim(produto_id)",
    "descricao_produto": _blank("descricao_produto"),
    "qtde_pedida": _dec("qtde_pedida", _QTY),
    "filial_id": _whole("filial_id", "INT"),
    "data_entrega": f"TRY_CAST({_blank('data_entrega')} AS DATE)",
    "qtde_entregue": f"CAST(coalesce({_ped_read['qtde_entregue']}, 0) AS {_QTY})",
    "qtde_pendente": (
        f"CAST(CASE WHEN coalesce({_dec('qtde_pedida', _QTY)}, 0) > coalesce({_ped_read['qtde_entregue']}, 0)"
        f" THEN coalesce({_dec('qtde_pedida', _QTY)}, 0) - coalesce({_ped_read['qtde_entregue']}, 0)"
        f" ELSE 0 END AS {_QTY})"
    ),
    "preco_compra": _dec("preco_compra", _PRICE),
    "fornecedor_id": _whole("fornecedor_id", "INT"),
}
_CTES["l_ped"] = _loaded(
    "r_ped", "pedido_id", _l_ped,
    _pick(
        {**_l_ped, **_ped_read}, "pedido_id", "item", "ordem_compra", "data_pedido", "qtde_pedida",
        "filial_id", "data_entrega", "qtde_entregue", "preco_compra", "fornecedor_id",
    ),
)

_l_ent = {
    "ordem_compra": _whole("ordem_compra", "BIGINT"),
    "nro_nfe": "trim(nro_nfe)",
    "item": _whole("item", "INT"),
    "produto_id": "trim(produto_id)",
    "descricao_produto": _blank("descricao_produto"),
    "data_entrada": f"TRY_CAST({_blank('data_entrada')} AS DATE)",
    "qtde_recebida": _dec("qtde_recebida", _QTY),
    "filial_id": _whole("filial_id", "INT"),
    "custo_unitario": _dec("custo_unitario", _PRICE),
}
_CTES["l_ent"] = _loaded(
    "r_ent", "nro_nfe", _l_ent,
    _pick(_l_ent, "ordem_compra", "item", "data_entrada", "qtde_recebida", "filial_id", "custo_unitario"),
)

_l_ven = {
    "venda_id": _whole("venda_id", "BIGINT"),
    "data_emissao": f"TRY_CAST({_blank('data_emissao')} AS DATE)",
    "horariomov": f"CASE WHEN {_blank('horariomov')} IS NULL THEN '00:00:00' ELSE {_CLOCK.format('horariomov')} END",
    "produto_id": "trim(produto_id)",
    "qtde_vendida": _dec("qtde_vendida", _QTY),
    "valor_unitario": _dec("valor_unitario", _PRICE),
    "filial_id": _whole("filial_id", "INT"),
    "item": _whole("item", "INT"),
    "unidade_medida": _blank("unidade_medida"),
}
_CTES["l_ven"] = _loaded(
    "r_ven", "venda_id", _l_ven,
    _pick(
        _l_ven, "venda_id", "data_emissao", "horariomov", "qtde_vendida", "valor_unitario",
        "filial_id", "item",
    ),
)

# Change events with the branch each takes, one event at a time.
_CTES["passo"] = """
SELECT *, op = 'UPDATE' AND new_idfornecedor IS DISTINCT FROM old_idfornecedor AS texto_mudou,
       op = 'UPDATE' AND new_idfornecedor_num IS DISTINCT FROM old_idfornecedor_num AS numero_mudou,
       CASE WHEN NOT (op = 'UPDATE' AND new_idfornecedor IS DISTINCT FROM old_idfornecedor)
            THEN new_idfornecedor_num END AS num,
       nullif(trim(new_idfornecedor), '') AS codigo
FROM mud"""
# The events one by one: ``novos`` are the codes registered so far, in that order.
_CTES["ordem"] = """
SELECT *, row_number() OVER (ORDER BY seq) AS i,
       EXISTS (SELECT 1 FROM forn WHERE forn.idfornecedor = passo.codigo) AS cadastrado FROM passo"""
_CTES["andar"] = """
SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS novos
UNION ALL
SELECT o.i, CASE WHEN o.num IS NULL AND o.codigo IS NOT NULL AND NOT o.cadastrado AND NOT list_contains(a.novos, o.codigo)
                 THEN list_append(a.novos, o.codigo) ELSE a.novos END
FROM andar a JOIN ordem o ON o.i = a.i + 1"""
_CTES["topo"] = "SELECT max(fornecedor_num) AS m FROM forn"
_CTES["novos"] = """
SELECT novos[k] AS idfornecedor, CAST(m + k AS INT) AS fornecedor_num,
       'FORNECEDOR PENDENTE DE CADASTRO - ' || novos[k] AS razao_social
FROM (SELECT novos, unnest(range(1, len(novos) + 1)) AS k FROM (SELECT novos FROM andar ORDER BY i DESC LIMIT 1)), topo"""
_CTES["resolvido"] = """
SELECT seq, op, filial_id, idproduto, new_idfornecedor, new_idfornecedor_num, texto_mudou, numero_mudou, ramo,
       CASE WHEN ramo = 'NUMERO' AND (new_idfornecedor IS NULL OR numero_mudou) THEN dono
            WHEN ramo = 'NUMERO' THEN new_idfornecedor
            WHEN ramo <> 'RECUSADO' THEN codigo END AS idfornecedor,
       CASE WHEN ramo = 'NUMERO' THEN num WHEN ramo = 'CODIGO' AND cadastrado THEN proprio
            WHEN ramo IN ('CODIGO', 'CODIGO NOVO') THEN CAST(m + list_position(depois, codigo) AS INT) END AS idfornecedor_num
FROM (
    SELECT p.*, m, d.novos AS depois, f.fornecedor_num AS proprio, coalesce(n.idfornecedor, a.novos[p.num - m]) AS dono,
           CASE WHEN p.num IS NOT NULL AND n.idfornecedor IS NULL AND NOT p.num - m BETWEEN 1 AND len(a.novos) THEN 'RECUSADO'
                WHEN p.num IS NOT NULL THEN 'NUMERO'
                WHEN p.codigo IS NULL THEN 'VAZIO'
                WHEN NOT p.cadastrado AND NOT list_contains(a.novos, p.codigo) THEN 'CODIGO NOVO' ELSE 'CODIGO' END AS ramo
    FROM ordem p JOIN andar a ON a.i = p.i - 1 JOIN andar d ON d.i = p.i, topo
    LEFT JOIN forn n ON n.fornecedor_num = p.num
    LEFT JOIN forn f ON p.num IS NULL AND f.idfornecedor = p.codigo
)"""

_NEEDS = {
    "l_forn": ["r_forn"], "l_cat": ["r_cat"], "l_ped": ["r_ped"], "l_ent": ["r_ent"], "l_ven": ["r_ven"],
    "passo": ["mud"], "ordem": ["passo", "forn"], "andar": ["ordem"], "topo": ["forn"],
    "novos": ["andar", "topo"], "resolvido": ["andar", "ordem", "topo", "forn"],
}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for wanted in (*_ordered(_NEEDS.get(name, [])), name):
            if wanted not in out:
                out.append(wanted)
    return out


def _query(tables: str, body: str, **local: str) -> str:
    ctes = {name: _CTES[name] for name in _ordered(tables.split())} | local
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes.items()) + "\n" + body


def _day(expr: str) -> str:
    return f"strftime({expr}, '%d/%m/%Y')"


def _money(expr: str, symbol: str = "R$ ") -> str:
    cents = f"CAST(CAST({expr} AS DECIMAL(38,2)) AS DOUBLE)"
    return f"'{symbol}' || translate(format('{{:,.2f}}', {cents}), ',.', '.,')"


def _cents(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(38,2))"


def _qsum(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(24,3))"


_FEB = "{0} >= DATE '1997-02-01' AND {0} < DATE '1997-03-01'"
_JAN_FEB = "{0} >= DATE '1997-01-01' AND {0} < DATE '1997-03-01'"
_YEAR = "{0} >= DATE '1997-01-01' AND {0} < DATE '1998-01-01'"
_LABEL = "CASE WHEN coalesce(trim({1}), '') = '' THEN {0} ELSE {0} || ' - ' || trim({1}) END"
_VALUE = "qtde_vendida * valor_unitario"

_RECEIVED = "SELECT ordem_compra, sum(qtde_recebida) AS q FROM ent WHERE ordem_compra <> 0 GROUP BY 1"
_OPEN = f"""
SELECT pedido_id, ped.ordem_compra, produto_id, descricao_produto, data_pedido, qtde_pedida,
       {_qsum('coalesce(q, 0)')} AS qtde_recebida,
       {_qsum('qtde_pedida - coalesce(q, 0)')} AS saldo_pendente,
       CASE WHEN ped.ordem_compra = 0 THEN 'ORDEM DE COMPRA ZERADA'
            WHEN rec.ordem_compra IS NULL THEN 'SEM ENTRADA VINCULADA'
            ELSE 'PARCIALMENTE RECEBIDO' END AS situacao
FROM ped LEFT JOIN rec ON rec.ordem_compra = ped.ordem_compra
WHERE ped.ordem_compra = 0 OR rec.ordem_compra IS NULL OR q < qtde_pedida"""


def _left_out(table) -> str:
    raw = f"r_{_ALIAS[table.name]}"
    key, readable = _READABLE[raw]
    faults = "".join(f", CASE WHEN {_bad(c, v)} THEN 'ilegivel:{c}' END" for c, v in readable)
    values = ", ".join(f"coalesce({c}, '')" for c in table.raw_columns)
    reason = f"CASE WHEN {_blank(key)} IS NULL THEN 'chave em branco' ELSE concat_ws(',', NULL{faults}) END"
    rows = f"SELECT '{table.name}' AS tabela, concat_ws('|', {values}) AS linha, {reason} AS motivo FROM {raw}"
    return f"SELECT * FROM ({rows}) WHERE motivo <> ''"


_STATE = (
    "SELECT filial_id, idproduto, idfornecedor AS codigo, idfornecedor_num AS numero, true AS mudou"
    " FROM resolvido WHERE ramo <> 'RECUSADO'"
    " QUALIFY row_number() OVER (PARTITION BY filial_id, idproduto ORDER BY seq DESC) = 1"
)
_PRODUCTS = (
    "SELECT * EXCLUDE (codigo, numero, mudou) REPLACE (CASE WHEN mudou THEN codigo ELSE idfornecedor END AS idfornecedor,"
    " CASE WHEN mudou THEN numero ELSE idfornecedor_num END AS idfornecedor_num)"
    " FROM cat FULL JOIN estado USING (filial_id, idproduto)"
)


def _order_vs_receipt(strict: bool) -> str:
    more = ", pedido_id, ped.item AS item" if strict else ""
    extra_on = " AND ent.item = ped.item AND ent.produto_id = ped.produto_id" if strict else ""
    got = "coalesce(sum(qtde_recebida), 0)"
    return _query(
        "ped ent",
        f"""
SELECT ordem_compra AS ordem,
       produto_id || coalesce(' - ' || descricao_produto, '') AS produto,
       {_day('data_pedido')} AS data_pedido, qtde_pedida AS pedido, qtde_entregue AS entregue,
       {_qsum('q')} AS recebido, {_qsum('q - qtde_entregue')} AS divergencia,
       CASE WHEN ordem_compra = 0 THEN 'SEM VINCULO' WHEN q = 0 THEN 'NAO RECEBIDO'
            WHEN q > qtde_pedida THEN 'RECEBIDO A MAIOR' WHEN q < qtde_pedida THEN 'PARCIAL'
            ELSE 'COMPLETO' END AS situacao{", pedido_id, item" if strict else ""}
FROM (SELECT ped.ordem_compra, ped.produto_id, ped.descricao_produto, data_pedido, qtde_pedida,
             qtde_entregue, {got} AS q{more}
      FROM ped LEFT JOIN ent
        ON ent.ordem_compra = ped.ordem_compra AND ped.ordem_compra <> 0{extra_on}
      WHERE {_FEB.format('data_pedido')} GROUP BY ALL)""",
    )


def _received_vs_order(columns: list[str], strict: bool) -> str:
    grain = columns + (["item"] if strict else [])
    extra_on = " AND ent.item = ped.item AND ent.produto_id = ped.produto_id" if strict else ""
    return (
        f"SELECT {', '.join('ped.' + c for c in grain)}, sum(qtde_recebida) AS q"
        f" FROM ped JOIN ent ON ent.ordem_compra = ped.ordem_compra{extra_on}"
        f" WHERE ped.ordem_compra <> 0 GROUP BY {', '.join('ped.' + c for c in grain)}"
    )


def _qa07(strict: bool = False) -> str:
    grain = ["ordem_compra", "pedido_id", "produto_id", "qtde_pedida"]
    more = ", item" if strict else ""
    return _query(
        "ped ent",
        f"SELECT {', '.join(grain)}{more}, {_qsum('q')} AS qtde_recebida,"
        f" {_qsum('q - qtde_pedida')} AS excesso FROM tot WHERE q > qtde_pedida",
        tot=_received_vs_order(grain, strict),
    )


def _qa08(strict: bool = False) -> str:
    grain = ["ordem_compra", "pedido_id", "produto_id", "qtde_pedida", "qtde_entregue"]
    more = ", item" if strict else ""
    return _query(
        "ped ent",
        f"SELECT ordem_compra, pedido_id, produto_id, qtde_pedida{more},"
        f" qtde_entregue AS qtde_entregue_pedido, {_qsum('q')} AS qtde_recebida_nf,"
        f" {_qsum('q - qtde_entregue')} AS divergencia FROM tot WHERE q <> qtde_entregue",
        tot=_received_vs_order(grain, strict),
    )


_LISTED = "EXISTS (SELECT 1 FROM cat WHERE cat.filial_id = ven.filial_id AND cat.idproduto = ven.produto_id)"
_LINE_TOTAL = f"CAST({_VALUE} AS DECIMAL(20,2)) AS valor_total"

_QA = {
    "QA-01": _query(
        "ven cat",
        f"SELECT venda_id, filial_id, produto_id, {_day('data_emissao')} AS data_emissao,"
        f" qtde_vendida, valor_unitario, {_LINE_TOTAL} FROM ven WHERE NOT {_LISTED}",
    ),
    "QA-02": _query(
        "ven cat",
        f"SELECT filial_id, count(*) AS qtde_vendas, {_cents(f'sum({_VALUE})')} AS valor_total"
        " FROM ven WHERE filial_id NOT IN (SELECT filial_id FROM cat) GROUP BY filial_id",
    ),
    "QA-03": _query(
        "ven",
        f"SELECT venda_id, produto_id, {_day('data_emissao')} AS data_emissao, qtde_vendida,"
        f" unidade_medida, {_LINE_TOTAL} FROM ven"
        " WHERE unidade_medida = 'UN' AND floor(qtde_vendida) <> qtde_vendida",
    ),
    "QA-04": _query(
        "ped",
        f"SELECT pedido_id, produto_id, item, {_day('data_pedido')} AS data_pedido, qtde_pedida,"
        " fornecedor_id FROM ped WHERE ordem_compra = 0",
    ),
    "QA-05": _query(
        "ped",
        f"SELECT pedido_id, produto_id, {_day('data_pedido')} AS data_pedido, ordem_compra,"
        " qtde_pedida, qtde_entregue, preco_compra,"
        " count(*) OVER (PARTITION BY produto_id, ped.data_pedido, preco_compra) AS ocorrencias"
        " FROM ped WHERE EXISTS (SELECT 1 FROM ped o WHERE o.produto_id = ped.produto_id"
        " AND o.data_pedido = ped.data_pedido AND o.preco_compra = ped.preco_compra"
        " AND o.pedido_id <> ped.pedido_id)",
    ),
    "QA-06": _query(
        "ped",
        f"SELECT pedido_id, produto_id, {_day('data_pedido')} AS data_pedido,"
        f" {_day('data_entrega')} AS data_entrega,"
        " CAST(ped.data_entrega - ped.data_pedido AS INT) AS dias_diferenca"
        " FROM ped WHERE ped.data_entrega < ped.data_pedido",
    ),
    "QA-07": _qa07(),
    "QA-08": _qa08(),
    # Percentage in whole numbers: prices in 1/10000, result in 1/100, rounded
    # away from zero (the margin is negative here).
    "QA-09": _query(
        "cat",
        "SELECT filial_id, idproduto, descricao, preco_compra, preco_venda, preco_unitario,"
        " CAST(preco_venda - preco_compra AS DECIMAL(14,2)) AS margem_absoluta,"
        " CAST(CASE WHEN preco_compra <> 0 THEN -0.01 * CAST("
        "(20000 * CAST((preco_compra - preco_venda) * 10000 AS BIGINT) + CAST(preco_compra * 10000 AS BIGINT))"
        " // (2 * CAST(preco_compra * 10000 AS BIGINT)) AS DECIMAL(16,0)) END AS DECIMAL(20,2))"
        " AS margem_percentual FROM cat WHERE preco_venda < preco_compra",
    ),
    "QA-10": _query(
        "ven cat",
        f"SELECT venda_id, produto_id, {_day('data_emissao')} AS data_emissao,"
        " valor_unitario AS preco_praticado, preco_venda AS preco_cadastro,"
        " preco_unitario AS preco_unitario_cadastro,"
        " CAST(valor_unitario - preco_venda AS DECIMAL(14,2)) AS diferenca"
        " FROM ven JOIN cat ON cat.filial_id = ven.filial_id AND cat.idproduto = ven.produto_id"
        " WHERE valor_unitario <> preco_venda",
    ),
    "QA-11": _query(
        "forn cat",
        "SELECT idfornecedor, fornecedor_num, razao_social FROM forn"
        " WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.idfornecedor = forn.idfornecedor)",
    ),
    "QA-12": _query(
        "ven",
        "SELECT strftime(data_emissao, '%m/%Y') AS competencia, count(*) AS qtde_vendas,"
        f" {_qsum('sum(qtde_vendida)')} AS qtde_total, {_cents(f'sum({_VALUE})')} AS valor_total,"
        " CASE WHEN strftime(data_emissao, '%m/%Y') = '02/1997' THEN 'ESCOPO DE VALIDACAO'"
        " ELSE 'fora do escopo' END AS situacao FROM ven GROUP BY 1, 5",
    ),
}


def _panel(until: str | None = None) -> str:
    """The scoreboard, optionally over sales and orders before a date."""
    parts = []
    for code, (title, severity) in SCOREBOARD.items():
        sql = _QA[code]
        if until:
            sql = sql.replace(
                "ven AS (" + _CTES["ven"], f"ven AS ({_CTES['ven']} WHERE o_orderdate < TIMESTAMP '{until}'"
            ).replace(
                "ped AS (" + _CTES["ped"], f"ped AS ({_CTES['ped']} WHERE o_orderdate < TIMESTAMP '{until}'"
            )
        parts.append(
            f"SELECT '{code}' AS cod, '{title}' AS verificacao, '{severity}' AS severidade,"
            f" count(*) AS ocorrencias FROM ({sql})"
        )
    return "\nUNION ALL ".join(parts)


def _key_text(keys) -> str:
    return " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '?')" for k in keys)


def _per_table(line, tables=TABLES) -> str:
    return "\nUNION ALL ".join(line(t) for t in tables.values())


def _c1(t) -> str:
    null = " OR ".join(f"{k} IS NULL" for k in t.key)
    return (
        f"SELECT '{t.name}' AS tabela, {_key_text(t.key)} AS chave,"
        f" CASE WHEN {null} THEN 'CHAVE NULA' ELSE 'CHAVE REPETIDA' END AS problema,"
        f" count(*) AS ocorrencias FROM {_ALIAS[t.name]} GROUP BY {', '.join(t.key)}"
        f" HAVING count(*) > 1 OR {null}"
    )


def _c3(t) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t.name}' AS tabela, '{c}' AS coluna, count(*) FILTER (WHERE {c} IS NULL) AS nulos"
        f" FROM l_{_ALIAS[t.name]}"
        for c in t.required
    )


def _c4(t) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t.name}' AS tabela, '{rule}' AS regra, {_key_text(t.key)} AS chave"
        f" FROM l_{_ALIAS[t.name]} WHERE NOT ({check})"
        for rule, check in t.checks.items()
    )


def _c5() -> str:
    parts = []
    for t in TABLES.values():
        for fk in t.foreign_keys:
            if fk.prospective:
                continue
            (child,), (parent,) = fk.columns, fk.parent_columns
            parts.append(
                f"SELECT '{fk.name}' AS restricao, CAST({child} AS VARCHAR) AS chave, count(*) AS linhas"
                f" FROM {_ALIAS[t.name]} c WHERE {child} IS NOT NULL AND NOT EXISTS"
                f" (SELECT 1 FROM {_ALIAS[fk.parent]} p WHERE p.{parent} = c.{child}) GROUP BY {child}"
            )
    return "\nUNION ALL ".join(parts)


def _c8(t) -> str:
    parts = []
    for c in t.columns:
        if c.name not in t.raw_columns:
            continue
        if c.length:
            rule, broken = f"ate {c.length} caracteres", f"length(trim({c.name})) > {c.length}"
        elif c.type.typeName() == "decimal":
            room = c.type.precision - c.type.scale
            rule = f"{room} digitos inteiros"
            broken = f"abs(round(TRY_CAST(trim({c.name}) AS DECIMAL(38,10)), {c.type.scale})) >= {10 ** room}"
        else:
            continue
        parts.append(
            f"SELECT '{t.name}' AS tabela, '{c.name}' AS coluna, '{rule}' AS regra,"
            f" count(*) FILTER (WHERE {broken}) AS ocorrencias FROM r_{_ALIAS[t.name]}"
        )
    return "\nUNION ALL ".join(parts)


_ALL = " ".join(_ALIAS.values())
_ALL_RAW = " ".join("r_" + a for a in _ALIAS.values())
_ALL_LOADED = " ".join("l_" + a for a in _ALIAS.values())
_SALES_COLUMNS = ", ".join(star.SALES)

def _kept(t) -> dict[str, str]:
    """CTEs of a judged load: sound rows, then those alone under their key."""
    alias = _ALIAS[t.name]
    sound = [f"{c} IS NOT NULL" for c in t.required]
    sound += [f"coalesce({check}, true)" for check in t.checks.values()]
    sound += [f"coalesce(length({c.name}) <= {c.length}, true)" for c in t.columns if c.length]
    ctes = {f"s_{alias}": f"SELECT * FROM l_{alias} WHERE {' AND '.join(sound)}"}
    last = f"s_{alias}"
    for i, keys in enumerate((t.key, *((u,) for u in t.unique))):
        ctes[f"k{i}_{alias}"] = (
            f"SELECT * FROM {last} QUALIFY count(*) OVER (PARTITION BY {', '.join(keys)}) = 1"
        )
        last = f"k{i}_{alias}"
    ctes[f"k_{alias}"] = f"SELECT * FROM {last}"
    return ctes


def _load_counts() -> str:
    local = {n: sql for t in TABLES.values() for n, sql in _kept(t).items()}
    registered = (
        " + (SELECT count(DISTINCT idfornecedor) FROM k_cat WHERE idfornecedor IS NOT NULL"
        " AND idfornecedor NOT IN (SELECT idfornecedor FROM k_forn))"
    )
    lines = _per_table(
        lambda t: f"SELECT '{t.name}' AS tabela, (SELECT count(*) FROM k_{_ALIAS[t.name]})"
        f"{registered if t.name == 'supplier' else ''} AS gravadas,"
        f" (SELECT count(*) FROM r_{_ALIAS[t.name]} WHERE {_blank(t.row_key)} IS NOT NULL)"
        f" - (SELECT count(*) FROM k_{_ALIAS[t.name]}) AS quarentena"
    )
    return _query(_ALL_RAW + " " + _ALL_LOADED, lines, **local)


_overflow = {f'"{n}"': n for n in star.OVERFLOW}
_block = ["data_pedido", "item", "produto_id", "descricao_produto", "ordem_compra", "qtde_pedida",
          "filial_id", "data_entrega", "qtde_entregue", "qtde_pendente", "preco_compra"]
_block_types = ["DATE", "INT", "VARCHAR", "VARCHAR", "BIGINT", _QTY, "INT", "DATE", _QTY, _QTY, _PRICE]
_compared = ["descricao_produto", "ordem_compra", "qtde_pedida", "filial_id", "data_entrega",
             "qtde_entregue", "preco_compra"]


def _block_value(column: str, source: str, dtype: str) -> str:
    if dtype == "DATE":
        return f"CAST(left({source}, 10) AS DATE) AS {column}"
    if column == "descricao_produto":
        return f"nullif(trim({source}), '') AS {column}"
    return f"CAST({source} AS {dtype}) AS {column}"


_A10 = _query(
    "sheet ped",
    f"""
SELECT o.pedido_id, b.produto_id,
       concat_ws(',', {', '.join(f"CASE WHEN o.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in _compared)})
         AS campos_divergentes,
       NOT ({' OR '.join(f"o.{c} IS DISTINCT FROM b.{c}" for c in _compared)}) AS igual,
       b.qtde_pendente IS NOT DISTINCT FROM b.qtde_pedida - b.qtde_entregue AS pendente_confere
FROM bloco b LEFT JOIN primeiro o USING (produto_id, data_pedido, item)""",
    bloco="SELECT "
    + ", ".join(_block_value(c, s, t) for c, s, t in zip(_block, _overflow, _block_types))
    + """ FROM sheet WHERE "Unnamed: 13" IS NOT NULL""",
    primeiro="SELECT pedido_id, produto_id, data_pedido, item, nullif(descricao_produto, '') AS descricao_produto,"
    " ordem_compra, qtde_pedida, filial_id, data_entrega, qtde_entregue, qtde_pendente, preco_compra FROM ped"
    " QUALIFY row_number() OVER (PARTITION BY produto_id, data_pedido, item"
    " ORDER BY pedido_id, "
    + ", ".join(f"{c} NULLS FIRST" for c in _block[3:])
    + ") = 1",
)

_DECISIONS = {
    "P13-1": "QA-01", "P13-2": "QA-02", "P13-3": "QA-03", "P13-4": "QA-05",
    "P13-5": "QA-08", "P13-6": "QA-09", "P13-8": "QA-06",
}

_P13 = (
    f"SELECT * FROM ({_QA['QA-10']}) ORDER BY abs(diferenca) DESC, venda_id, produto_id,"
    " preco_praticado, data_emissao LIMIT 10"
)


_TEXT = "coalesce(CAST({} AS VARCHAR), '?')"


def _row_text(values: list[str]) -> str:
    return " || '|' || ".join(_TEXT.format(v) for v in values)


_WIDE_RAW = "coalesce(CAST(TRY_CAST(trim({0}) AS DECIMAL(18,6)) AS VARCHAR), trim({0}))"
_RAW_KEYS = [_whole("venda_id", "BIGINT"), "trim(produto_id)", _whole("item", "INT")]
_RAW_KEY = ", ".join(f"{v} AS {c}" for v, c in zip(_RAW_KEYS, ("venda_id", "produto_id", "item")))
_RAW_ROW = _row_text([
    "trim(data_emissao)", f"coalesce({_blank('horariomov')}, '00:00:00')", _WIDE_RAW.format("qtde_vendida"), _WIDE_RAW.format("valor_unitario"),
    f"coalesce(CAST({_whole('filial_id', 'INT')} AS VARCHAR), trim(filial_id))", _blank("unidade_medida"),
])
_TYPED_ROW = _row_text([
    "data_emissao", "horariomov", "CAST(qtde_vendida AS DECIMAL(18,6))", "CAST(valor_unitario AS DECIMAL(18,6))", "filial_id", "unidade_medida",
])
_RAW_ALL = (
    f"SELECT {_RAW_KEY}, md5({_row_text(_RAW_KEYS)}) AS k, md5({_row_text(_RAW_KEYS)} || '|' || {_RAW_ROW}) AS h"
    f" FROM r_ven WHERE {_blank('venda_id')} IS NOT NULL"
)
_TYPED_KEYS = _row_text(["venda_id", "produto_id", "item"])
_TYPED_ALL = f"SELECT venda_id, produto_id, item, md5({_TYPED_KEYS}) AS k, md5({_TYPED_KEYS} || '|' || {_TYPED_ROW}) AS h FROM l_ven"


def _digests(by: str, side: str, rows: str) -> str:
    sums = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)) AS VARCHAR)" for at in (1, 16))
    bucket = "CAST(CAST('0x' || substr(k, 1, 8) AS BIGINT) % 4096 AS INT)"
    return (
        f"SELECT {by}, count(*) AS linhas_{side}, {sums} AS digest_{side}"
        f" FROM (SELECT *, {bucket} AS bucket FROM ({rows})) GROUP BY ALL"
    )


def oracle_sql() -> dict[str, str]:
    out = {
        # ---- sources ----
        "A1": _query("r_ven", "SELECT * FROM r_ven"),
        "A2": _query("sheet", f"SELECT {', '.join(TABLES['purchase_order'].raw_columns)} FROM sheet"),
        "A3": _query(
            "sheet",
            f"SELECT {', '.join(_overflow)} FROM sheet WHERE coalesce({', '.join(_overflow)}) IS NOT NULL",
        ),
        "A4": _query(
            "sheet",
            "SELECT "
            + ", ".join(
                "left(data_pedido, 10) AS data_pedido" if c == "data_pedido" else c
                for c in TABLES["purchase_order"].raw_columns
            )
            + " FROM sheet",
        ),
        "A5": _query(
            _ALL_RAW + " sheet",
            _per_table(
                lambda t: f"SELECT '{t.file}' AS tabela, count(*) AS linhas,"
                f" {len(t.raw_columns)} AS colunas_mantidas,"
                f" {23 if t.name == 'purchase_order' else len(t.raw_columns)} AS colunas_encontradas,"
                f" {11 if t.name == 'purchase_order' else 0} AS colunas_sem_cabecalho,"
                + (
                    ' count("Unnamed: 13") AS linhas_sem_cabecalho FROM sheet'
                    if t.name == "purchase_order"
                    else f" CAST(0 AS BIGINT) AS linhas_sem_cabecalho FROM r_{_ALIAS[t.name]}"
                )
            ),
        ),
        "A6": _query("r_ped", "SELECT * FROM r_ped"),
        "A7": _query("ven", "SELECT * FROM ven"),
        "A8": _query("l_ped", "SELECT * FROM l_ped"),
        "A9": "\nUNION ALL ".join(
            f"SELECT '{RULE_VIEWS[code]}' AS visao, count(*) AS linhas FROM ({sql})"
            for code, sql in {**_QA, "QA-P": _panel()}.items()
        ),
        "A10": _A10,
        # ---- loads ----
        "B1": _query("l_forn", "SELECT * FROM l_forn"),
        "B1-issues": _query(
            "l_forn",
            "SELECT idfornecedor, fornecedor_num, 'SEM NUMERO' AS problema FROM l_forn WHERE fornecedor_num IS NULL"
            " UNION ALL SELECT idfornecedor, fornecedor_num, 'NUMERO REPETIDO' FROM l_forn a WHERE EXISTS"
            " (SELECT 1 FROM l_forn b WHERE b.fornecedor_num = a.fornecedor_num"
            " AND b.idfornecedor <> a.idfornecedor)",
        ),
        "B2": _query("l_cat", "SELECT * FROM l_cat"),
        "B3": _query("l_ped", "SELECT * FROM l_ped"),
        "B4": _query("l_ent", "SELECT * FROM l_ent"),
        "B5": _query("l_ven", "SELECT * FROM l_ven"),
        "B6": _query(
            _ALL_RAW,
            _per_table(
                lambda t: f"SELECT '{t.name}' AS tabela, count(*) AS lidas,"
                f" count(*) FILTER (WHERE {_blank(t.row_key)} IS NULL) AS puladas FROM r_{_ALIAS[t.name]}"
            ),
        ),
        "B7": _query(
            "ven forn",
            "SELECT produto_id, CAST((SELECT max(fornecedor_num) FROM forn)"
            " + row_number() OVER (ORDER BY produto_id) AS INT) AS numero"
            " FROM (SELECT DISTINCT produto_id FROM ven)",
        ),
        "LOAD": _load_counts(),
        # ---- integrity ----
        "C1": _query(_ALL, _per_table(_c1)),
        "C2": _query(
            "l_forn",
            "SELECT 'supplier' AS tabela, 'fornecedor_num' AS coluna, CAST(fornecedor_num AS VARCHAR) AS valor,"
            " count(*) AS ocorrencias FROM l_forn WHERE fornecedor_num IS NOT NULL"
            " GROUP BY fornecedor_num HAVING count(*) > 1",
        ),
        "C3": _query(_ALL_LOADED, _per_table(_c3)),
        "C4": _query(_ALL_LOADED, _per_table(_c4)),
        "C5": _query("forn cat ped", _c5()),
        "C6": _query(
            "ven cat",
            f"SELECT {_SALES_COLUMNS}, filial_id IS NULL OR produto_id IS NULL OR {_LISTED} AS aceito FROM ven",
        ),
        "C7": _query(
            "ven cat",
            "SELECT 'venda_produto' AS restricao, count(*) AS violacoes, count(*) = 0 AS valida"
            f" FROM ven WHERE NOT {_LISTED}",
        ),
        "C7-bucketed": _query(
            "ven cat",
            "SELECT 'venda_produto' AS restricao, count(*) AS violacoes, count(*) = 0 AS valida"
            f" FROM ven WHERE NOT {_LISTED}",
        ),
        "C8": _query(_ALL_RAW, _per_table(_c8)),
        "C9": _query(
            "cat forn",
            "SELECT cat.* REPLACE (CASE WHEN m.velho IS NULL THEN cat.idfornecedor ELSE m.novo END AS idfornecedor)"
            " FROM cat LEFT JOIN mudanca m ON m.velho = cat.idfornecedor",
            mudanca="SELECT idfornecedor AS velho,"
            " CASE WHEN fornecedor_num % 10 = 3 THEN idfornecedor || '-B' END AS novo"
            " FROM forn WHERE fornecedor_num % 10 IN (3, 5)",
        ),
        "C9-all": _query(
            "cat forn ped",
            "SELECT 'supplier' AS tabela, CAST(NULL AS INT) AS parte, coalesce(m.novo, f.idfornecedor) AS chave,"
            " coalesce(m.novo, f.idfornecedor) AS codigo, coalesce(m.numero, f.fornecedor_num) AS numero"
            " FROM forn f LEFT JOIN mudanca m ON m.velho = f.idfornecedor WHERE NOT coalesce(m.fora, false)"
            " UNION ALL SELECT 'branch_product', filial_id, idproduto,"
            " CASE WHEN a.velho IS NULL THEN idfornecedor ELSE a.novo END, CASE WHEN b.velho IS NULL THEN idfornecedor_num ELSE b.numero END"
            " FROM cat LEFT JOIN mudanca a ON a.velho = cat.idfornecedor LEFT JOIN mudanca b ON b.antes = cat.idfornecedor_num"
            " UNION ALL SELECT 'purchase_order', item, CAST(pedido_id AS VARCHAR) || '|' || produto_id, NULL,"
            " CASE WHEN b.velho IS NULL THEN fornecedor_id ELSE b.numero END"
            " FROM ped LEFT JOIN mudanca b ON b.antes = ped.fornecedor_id",
            mudanca="SELECT idfornecedor AS velho, fornecedor_num AS antes, fornecedor_num % 10 = 5 AS fora,"
            " CASE fornecedor_num % 10 WHEN 3 THEN idfornecedor || '-B' WHEN 7 THEN idfornecedor END AS novo,"
            " CAST(CASE fornecedor_num % 10 WHEN 3 THEN fornecedor_num WHEN 7 THEN fornecedor_num + 500000 END AS INT) AS numero"
            " FROM forn WHERE fornecedor_num % 10 IN (3, 5, 7)",
        ),
        "C10": _query(
            "ven",
            "SELECT venda_id, data_emissao, '00:00:00' AS horariomov, produto_id, qtde_vendida,"
            " CAST(0 AS DECIMAL(12,4)) AS valor_unitario, filial_id, 1 AS item,"
            " CAST(NULL AS VARCHAR) AS unidade_medida FROM ven",
        ),
        "C11": _query(
            "cat ped",
            "SELECT 'margem_nao_negativa' AS regra, 'branch_product' AS tabela, 'report' AS severidade,"
            " count(*) AS ocorrencias FROM cat WHERE preco_venda < preco_compra UNION ALL"
            " SELECT 'entrega_apos_pedido', 'purchase_order', 'report', count(*) FROM ped"
            " WHERE data_entrega < data_pedido",
        ),
        # ---- supplier resolution ----
        "T1": _query("passo", "SELECT seq, op, texto_mudou, numero_mudou FROM passo"),
        "T2": _query("passo", "SELECT seq, new_idfornecedor, num FROM passo"),
        **{
            key: _query(
                "resolvido",
                f"SELECT seq, filial_id, idproduto, idfornecedor, idfornecedor_num FROM resolvido WHERE ramo = '{ramo}'",
            )
            for key, ramo in (("T3", "NUMERO"), ("T5", "VAZIO"), ("T6", "CODIGO"))
        },
        "T4": _query(
            "resolvido",
            "SELECT seq, filial_id, idproduto, new_idfornecedor_num, 'idfornecedor_num ' ||"
            " CAST(new_idfornecedor_num AS VARCHAR) || ' nao existe em fornecedor (produto ' || idproduto ||"
            " ', filial ' || CAST(filial_id AS VARCHAR) || ')' AS motivo FROM resolvido WHERE ramo = 'RECUSADO'",
        ),
        "T7": _query("novos", "SELECT * FROM novos"),
        "T8": _query(
            "cat forn",
            "SELECT cat.* REPLACE (coalesce(idfornecedor_num, (SELECT min(fornecedor_num) FROM forn"
            " WHERE forn.idfornecedor = cat.idfornecedor)) AS idfornecedor_num) FROM cat",
        ),
        "T9": _query(
            "cat",
            "SELECT count(*) AS total_produtos, count(idfornecedor_num) AS com_vinculo_numerico,"
            " count(*) - count(idfornecedor_num) AS sem_vinculo FROM cat",
        ),
        "T-state": _query(
            "resolvido",
            "SELECT filial_id, idproduto, idfornecedor, idfornecedor_num FROM resolvido WHERE ramo <> 'RECUSADO'"
            " QUALIFY row_number() OVER (PARTITION BY filial_id, idproduto ORDER BY seq DESC) = 1",
        ),
        "T-products": _query("cat resolvido", "SELECT * FROM produtos", estado=_STATE, produtos=_PRODUCTS),
        "T-notices": _query(
            "novos",
            "SELECT idfornecedor, 'novo cadastro ' || idfornecedor || ': numero ' || CAST(fornecedor_num AS VARCHAR)"
            " || ', nome a completar' AS aviso FROM novos",
        ),
        "T-mismatch": _query(
            "cat forn novos resolvido",
            "SELECT filial_id, idproduto, p.idfornecedor, idfornecedor_num, dono_do_numero FROM produtos p"
            " JOIN (SELECT fornecedor_num, min(idfornecedor) AS dono_do_numero FROM"
            " (SELECT idfornecedor, fornecedor_num FROM forn UNION ALL SELECT idfornecedor, fornecedor_num FROM novos)"
            " GROUP BY 1) d ON d.fornecedor_num = p.idfornecedor_num WHERE trim(p.idfornecedor) <> dono_do_numero",
            estado=_STATE,
            produtos=_PRODUCTS,
        ),
        # ---- reports ----
        "P1": _query(
            "ven cat",
            f"""
SELECT ven.produto_id, coalesce(cat.descricao, '*** SEM CADASTRO ***') AS descricao,
       ven.filial_id AS filial, count(*) AS qtde_notas,
       {_qsum('sum(qtde_vendida)')} AS qtde_total_vendida, {_cents(f'sum({_VALUE})')} AS valor_total_reais,
       CAST(CAST((2 * sum(CAST(valor_unitario * 10000 AS BIGINT)) + 100 * count(*)) // (200 * count(*))
            AS DECIMAL(16,0)) * 0.01 AS DECIMAL(14,2)) AS preco_medio_unitario
FROM ven LEFT JOIN cat ON cat.idproduto = ven.produto_id AND cat.filial_id = ven.filial_id
WHERE {_FEB.format('data_emissao')} GROUP BY ven.produto_id, cat.descricao, ven.filial_id""",
        ),
        "P2": _query(
            "ven",
            f"""
SELECT produto_id, {_qsum('sum(qtde_vendida)')} AS qtde_total_vendida, {_cents(f'sum({_VALUE})')} AS valor_total_reais
FROM ven WHERE {_FEB.format('data_emissao')} GROUP BY produto_id
UNION ALL
SELECT '>>> TOTAL FEVEREIRO/1997', {_qsum('sum(qtde_vendida)')}, {_cents(f'sum({_VALUE})')}
FROM ven WHERE {_FEB.format('data_emissao')}""",
        ),
        "P3": _query(
            "ped ent",
            f"SELECT * REPLACE ({_day('data_pedido')} AS data_pedido) FROM aberto",
            rec=_RECEIVED,
            aberto=_OPEN,
        ),
        "P4": _query(
            "ped ent",
            f"SELECT situacao, count(*) AS qtde_pedidos, {_qsum('sum(saldo_pendente)')} AS saldo_total_pendente"
            " FROM aberto GROUP BY situacao",
            rec=_RECEIVED,
            aberto=_OPEN,
        ),
        "P5": _query(
            "ped",
            f"""
SELECT {_LABEL.format('produto_id', 'descricao_produto')} AS produto,
       {_qsum('sum(qtde_pedida)')} AS qtde_requisitada, count(*) AS qtde_solicitacoes,
       {_day('min(data_pedido)')} AS data_solicitacao, {_day('max(data_pedido)')} AS ultima_solicitacao
FROM ped WHERE {_JAN_FEB.format('data_pedido')} GROUP BY 1 HAVING sum(qtde_pedida) > 10""",
        ),
        "P6": _query(
            "ped",
            f"""
SELECT {_LABEL.format('produto_id', 'descricao_produto')} AS produto,
       {_qsum('sum(qtde_pedida)')} AS qtde_requisitada, count(*) AS qtde_solicitacoes,
       {_day('min(data_pedido)')} AS data_solicitacao
FROM ped WHERE {_YEAR.format('data_pedido')} GROUP BY 1 HAVING count(*) > 10""",
        ),
        "P7": _query(
            "ven cat",
            f"""
SELECT {_LABEL.format('ven.produto_id', 'cat.descricao')} AS produto,
       {_qsum('sum(qtde_vendida)')} AS qtde_requisitada, {_day('min(data_emissao)')} AS data_solicitacao,
       {_cents(f'sum({_VALUE})')} AS valor_total,
       CASE WHEN cat.idproduto IS NULL THEN 'PRODUTO SEM CADASTRO' END AS alerta
FROM ven LEFT JOIN cat ON cat.idproduto = ven.produto_id AND cat.filial_id = ven.filial_id
WHERE {_JAN_FEB.format('data_emissao')} GROUP BY 1, cat.idproduto HAVING sum(qtde_vendida) > 10""",
        ),
        "P8": _query(
            "cat forn ped",
            f"""
SELECT {_LABEL.format('cat.idproduto', 'cat.descricao')} AS produto, cat.filial_id AS filial,
       concat_ws(' - ', forn.idfornecedor, forn.razao_social) AS fornecedor,
       forn.fornecedor_num AS cod_fornecedor_num, cat.estoque,
       {_money('cat.preco_compra', '')} AS preco_compra, {_money('cat.preco_venda', '')} AS preco_venda,
       {_qsum('o.q')} AS qtde_requisitada, {_day('o.primeira')} AS data_solicitacao
FROM cat LEFT JOIN forn ON forn.idfornecedor = cat.idfornecedor,
     LATERAL (SELECT sum(qtde_pedida) AS q, min(data_pedido) AS primeira FROM ped
              WHERE ped.produto_id = cat.idproduto AND {_JAN_FEB.format('data_pedido')}) o
WHERE o.q > 10""",
        ),
        "P9": _query(
            "ven",
            f"""
SELECT 'Fevereiro/1997' AS periodo, count(*) AS qtde_lancamentos,
       count(DISTINCT produto_id) AS produtos_distintos, count(DISTINCT filial_id) AS filiais,
       {_qsum('sum(qtde_vendida)')} AS qtde_total, {_money(f'sum({_VALUE})')} AS faturamento_total,
       {_day('min(data_emissao)')} AS primeira_venda, {_day('max(data_emissao)')} AS ultima_venda
FROM ven WHERE {_FEB.format('data_emissao')}""",
        ),
        "P10": _query(
            "ven",
            f"SELECT {_day('data_emissao')} AS dia, strftime(data_emissao, '%a') AS dia_semana,"
            f" count(*) AS lancamentos, {_money(f'sum({_VALUE})')} AS faturamento FROM ven"
            f" WHERE {_FEB.format('data_emissao')} GROUP BY ven.data_emissao",
        ),
        "P11": _order_vs_receipt(False),
        "P11-strict": _order_vs_receipt(True),
        "P12": _query(
            "cat ent ven",
            f"""
SELECT concat_ws(' - ', idproduto, descricao) AS produto, estoque AS estoque_atual,
       {_qsum('entrou')} AS entradas, {_qsum('saiu')} AS saidas, {_qsum('entrou - saiu')} AS saldo_do_mes,
       CASE WHEN estoque < 0 THEN 'ESTOQUE NEGATIVO' WHEN saiu > estoque + entrou
            THEN 'SAIDA MAIOR QUE DISPONIVEL' ELSE 'ok' END AS alerta
FROM (SELECT cat.*,
        coalesce((SELECT sum(qtde_recebida) FROM ent WHERE ent.produto_id = cat.idproduto
                  AND ent.filial_id = cat.filial_id AND {_FEB.format('data_entrada')}), 0) AS entrou,
        coalesce((SELECT sum(qtde_vendida) FROM ven WHERE ven.produto_id = cat.idproduto
                  AND ven.filial_id = cat.filial_id AND {_FEB.format('data_emissao')}), 0) AS saiu
      FROM cat)""",
        ),
        "P13": _P13,
        "P13-7": _P13,
        **{key: _QA[code] for key, code in _DECISIONS.items()},
        "P14": _query(
            "ven dia",
            "SELECT filial_id, produto_id, min(d) AS primeiro_dia, max(d) AS ultimo_dia,"
            " CAST(count(*) FILTER (WHERE isodow(d) < 6) AS INT) AS dias_uteis"
            " FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY filial_id, produto_id ORDER BY d) AS INT) AS ilha"
            " FROM (SELECT DISTINCT filial_id, produto_id FROM ven), dia"
            " WHERE (filial_id, produto_id, d) NOT IN (SELECT (filial_id, produto_id, data_emissao) FROM ven))"
            " GROUP BY filial_id, produto_id, ilha HAVING count(*) FILTER (WHERE isodow(d) < 6) > 0",
        ),
        "P14-days": _query(
            "ven dia",
            f"SELECT {_day('d')} AS dia, strftime(d, '%a') AS dia_semana FROM dia"
            " WHERE isodow(d) < 6 AND d NOT IN (SELECT data_emissao FROM ven)",
        ),
        # ---- quality ----
        **_QA,
        "QA-07-strict": _qa07(strict=True),
        "QA-08-strict": _qa08(strict=True),
        "QA-P": _panel(),
        # ---- reconciliation ----
        "LOAD-counts": _query(
            _ALL_RAW + " " + _ALL_LOADED,
            _per_table(
                lambda t: f"SELECT '{t.name}' AS tabela, m.medida, m.valor FROM"
                f" (SELECT count(*) AS lidas, count(*) FILTER (WHERE {_blank(t.row_key)} IS NULL) AS puladas FROM r_{_ALIAS[t.name]}) a,"
                f" (SELECT count(*) AS final{''.join(f', count(*) FILTER (WHERE {c} IS NULL) AS n_{c}' for c in t.required)} FROM l_{_ALIAS[t.name]}) b,"
                " (VALUES ('lidas', a.lidas), ('puladas', a.puladas), ('ilegiveis', a.lidas - a.puladas - b.final), ('final', b.final)"
                f"{''.join(f", ('nulos:{c}', b.n_{c})" for c in t.required)}) m(medida, valor)"
            ),
        ),
        "LOAD-out": _query(_ALL_RAW, _per_table(_left_out)),
        "R1": _query(
            _ALL_RAW + " " + _ALL_LOADED,
            _per_table(
                lambda t: f"SELECT '{t.name}' AS tabela, (SELECT count(*) FROM r_{_ALIAS[t.name]}) AS staging,"
                f" (SELECT count(*) FROM l_{_ALIAS[t.name]}) AS final"
            ),
        ),
        "R2": _query(
            _ALL_RAW + " " + _ALL_LOADED,
            _per_table(
                lambda t: f"SELECT '{t.name}' AS tabela, (SELECT count(*) FROM r_{_ALIAS[t.name]}) AS origem_planilha,"
                f" (SELECT count(*) FROM l_{_ALIAS[t.name]}) AS carregado_banco,"
                f" (SELECT count(*) FROM r_{_ALIAS[t.name]}) - (SELECT count(*) FROM l_{_ALIAS[t.name]}) AS diferenca"
            ),
        ),
        "R3": _query(
            "r_ven l_ven",
            f"SELECT {_cents('o')} AS total_origem, {_cents('d')} AS total_destino, {_cents('o - d')} AS diferenca, ilegiveis AS linhas_ilegiveis"
            " FROM (SELECT CAST(sum(q * p) AS DECIMAL(38,12)) AS o, count(*) - count(q * p) AS ilegiveis,"
            f" (SELECT CAST(sum({_VALUE}) AS DECIMAL(38,12)) FROM l_ven) AS d"
            " FROM (SELECT TRY_CAST(trim(qtde_vendida) AS DECIMAL(18,6)) AS q, TRY_CAST(trim(valor_unitario) AS DECIMAL(18,6)) AS p FROM r_ven))",
        ),
        "R4": _query(
            "ven",
            "SELECT filial_id, venda_id, produto_id, item, count(*) AS ocorrencias,"
            " count(DISTINCT horariomov) AS horarios_distintos FROM ven GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
        ),
        "R5": _query(
            "r_ven l_ven",
            "SELECT * EXCLUDE (todas_origem, todas_destino), todas_origem IS NOT DISTINCT FROM todas_destino AS igual"
            " FROM antes FULL JOIN depois USING (venda_id, produto_id, item)",
            antes=f"SELECT {_RAW_KEY}, count(*) AS linhas_origem, min(data_emissao) AS data_origem, max(data_emissao) AS ultima_data_origem,"
            f" {_qsum('sum(TRY_CAST(qtde_vendida AS DECIMAL(14,3)))')} AS qtde_origem,"
            " CAST(sum(TRY_CAST(trim(valor_unitario) AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS soma_valor_origem,"
            f" max(valor_unitario) AS valor_origem, list({_RAW_ROW} ORDER BY {_RAW_ROW}) AS todas_origem"
            f" FROM r_ven WHERE {_blank('venda_id')} IS NOT NULL GROUP BY 1, 2, 3",
            depois="SELECT venda_id, produto_id, item, count(*) AS linhas_destino, min(data_emissao) AS data_destino, max(data_emissao) AS ultima_data_destino,"
            f" {_qsum('sum(qtde_vendida)')} AS qtde_destino, max(valor_unitario) AS valor_destino,"
            " CAST(sum(valor_unitario) AS DECIMAL(28,6)) AS soma_valor_destino,"
            f" list({_TYPED_ROW} ORDER BY {_TYPED_ROW}) AS todas_destino FROM l_ven GROUP BY 1, 2, 3",
        ),
        "R5-buckets": _query(
            "r_ven l_ven",
            "SELECT *, linhas_origem IS NOT DISTINCT FROM linhas_destino AND digest_origem IS NOT DISTINCT FROM digest_destino AS igual"
            " FROM antes FULL JOIN depois USING (bucket)",
            antes=_digests("bucket", "origem", _RAW_ALL),
            depois=_digests("bucket", "destino", _TYPED_ALL),
        ),
        "R5-changed": _query(
            "r_ven l_ven",
            "SELECT *, false AS igual FROM antes FULL JOIN depois USING (venda_id, produto_id, item)"
            " WHERE NOT (linhas_origem IS NOT DISTINCT FROM linhas_destino AND digest_origem IS NOT DISTINCT FROM digest_destino)",
            movida="SELECT * REPLACE (CAST(qtde_vendida + CASE WHEN venda_id % 53 = 1 AND item = 1 THEN 1"
            " WHEN venda_id % 53 = 1 AND item = 2 THEN -1 ELSE 0 END AS DECIMAL(14,3)) AS qtde_vendida) FROM l_ven",
            antes=_digests("venda_id, produto_id, item", "origem", _RAW_ALL),
            depois=_digests("venda_id, produto_id, item", "destino", _TYPED_ALL.replace("FROM l_ven", "FROM movida")),
        ),
        "R6": _query(
            "ven cat",
            "SELECT o AS ocorrencias, v AS violacoes_fk, o = 0 AND v = 0 AS aceito FROM"
            f" (SELECT (SELECT CAST(sum(ocorrencias) AS BIGINT) FROM ({_panel()})) AS o,"
            f" (SELECT count(*) FROM ven WHERE NOT {_LISTED}) AS v)",
        ),
        # ---- streams ----
        "ST1": _query(
            "cat",
            f"SELECT {', '.join(star.projection({c: star.SALES[c] for c in ('venda_id', 'item', 'filial_id', 'produto_id', 'horariomov')}))},"
            f" EXISTS (SELECT 1 FROM cat WHERE cat.filial_id = {star.SALES['filial_id']}"
            f" AND cat.idproduto = {star.SALES['produto_id']}) AS aceito FROM lineitem",
        ),
        "ST2": _query(
            "resolvido",
            "SELECT seq, filial_id, idproduto, ramo, idfornecedor, idfornecedor_num FROM resolvido",
        ),
        "ST3": "SELECT *, ocorrencias - lag(ocorrencias) OVER (PARTITION BY cod ORDER BY data_execucao) AS variacao"
        f" FROM (SELECT *, DATE '2026-01-01' AS data_execucao FROM ({_panel('1998-01-01')})"
        f" UNION ALL SELECT *, DATE '2026-01-02' FROM ({_panel()}))",
        "ST4": "SELECT CAST(ts AS DATE) AS dia, user_id, event_type, count(*) AS ocorrencias,"
        " count(DISTINCT strftime(ts, '%H:%M:%S')) AS horarios_distintos FROM events"
        " GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "ST4-late": "SELECT CAST(ts AS DATE) AS dia, user_id, event_type, date_trunc('second', ts) AS horario FROM events"
        " WHERE event_id % 10 = 9 AND CAST(ts AS DATE) + INTERVAL 1 DAY <="
        " (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE event_id % 10 <> 9) - INTERVAL 2 DAY",
    }
    return out
