"""Wording of the results. Everything in this module is a fixed value."""

# Catalogue and order labels
UNCATALOGUED = "*** SEM CADASTRO ***"
UNCATALOGUED_ALERT = "PRODUTO SEM CADASTRO"
TOTAL_PREFIX = ">>> TOTAL "

# Open orders
ZEROED = "ORDEM DE COMPRA ZERADA"
UNLINKED = "SEM ENTRADA VINCULADA"
PARTIAL = "PARCIALMENTE RECEBIDO"

# Order against receipt
NO_LINK = "SEM VINCULO"
NOT_RECEIVED = "NAO RECEBIDO"
OVER_RECEIVED = "RECEBIDO A MAIOR"
PART_RECEIVED = "PARCIAL"
COMPLETE = "COMPLETO"

# Stock movement
NEGATIVE_STOCK = "ESTOQUE NEGATIVO"
OVERSOLD = "SAIDA MAIOR QUE DISPONIVEL"
STOCK_OK = "ok"

# Scope of a month
IN_SCOPE = "ESCOPO DE VALIDACAO"
OUT_OF_SCOPE = "fora do escopo"

# Suppliers registered by the resolver
PENDING_SUPPLIER = "FORNECEDOR PENDENTE DE CADASTRO - "
UNKNOWN_NUMBER = "idfornecedor_num %d nao existe em fornecedor (produto %s, filial %d)"

# Severities, most serious first
SEVERITIES = ("CRITICA", "ALTA", "MEDIA", "BAIXA")

# Scoreboard: code -> (title, severity)
SCOREBOARD = {
    "QA-01": ("Vendas de produto sem cadastro", "ALTA"),
    "QA-02": ("Vendas em filial sem cadastro", "ALTA"),
    "QA-03": ("Qtde fracionaria em unidade UN", "MEDIA"),
    "QA-04": ("Pedido com ordem de compra zerada", "ALTA"),
    "QA-05": ("Pedidos duplicados", "ALTA"),
    "QA-06": ("Entrega anterior ao pedido", "MEDIA"),
    "QA-07": ("Recebido maior que pedido", "ALTA"),
    "QA-08": ("Divergencia qtde_entregue x NF", "CRITICA"),
    "QA-09": ("Produto com margem negativa", "ALTA"),
    "QA-10": ("Preco de venda divergente do cadastro", "MEDIA"),
    "QA-11": ("Fornecedor sem produto vinculado", "BAIXA"),
}

# View names of the quality rules
RULE_VIEWS = {
    "QA-01": "vw_venda_produto_sem_cadastro",
    "QA-02": "vw_venda_filial_sem_cadastro",
    "QA-03": "vw_venda_qtde_fracionaria",
    "QA-04": "vw_pedido_sem_ordem_compra",
    "QA-05": "vw_pedido_duplicado",
    "QA-06": "vw_pedido_data_invertida",
    "QA-07": "vw_recebido_maior_que_pedido",
    "QA-08": "vw_divergencia_entregue_vs_nf",
    "QA-09": "vw_produto_margem_negativa",
    "QA-10": "vw_venda_preco_divergente",
    "QA-11": "vw_fornecedor_sem_produto",
    "QA-12": "vw_venda_por_competencia",
    "QA-P": "vw_painel_qualidade",
}

MONTHS = (
    "Janeiro", "Fevereiro", "Marco", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)

# Weekday abbreviations, Sunday first
WEEKDAYS = {
    "en": ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"),
    "pt": ("Dom", "Seg", "Ter", "Qua", "Qui", "Sex", "Sab"),
}

# Report headings shown to a reader, by column name
HEADINGS = {
    "requisitions": {
        "produto": "Produto",
        "qtde_requisitada": "Qtde Requisitada",
        "data_solicitacao": "Data Solicitacao",
        "qtde_solicitacoes": "Qtde Solicitacoes",
        "ultima_solicitacao": "Ultima Solicitacao",
    },
    "sales_by_label": {
        "produto": "Produto",
        "qtde_requisitada": "Qtde Requisitada",
        "data_solicitacao": "Data Solicitacao",
        "valor_total": "Valor Total (R$)",
        "alerta": "Alerta",
    },
    "catalogue": {
        "produto": "Produto",
        "filial": "Filial",
        "fornecedor": "Fornecedor",
        "cod_fornecedor_num": "Cod. Fornecedor (num)",
        "estoque": "Estoque",
        "preco_compra": "Preco Compra",
        "preco_venda": "Preco Venda",
        "qtde_requisitada": "Qtde Requisitada",
        "data_solicitacao": "Data Solicitacao",
    },
    "order_vs_receipt": {
        "ordem": "Ordem",
        "produto": "Produto",
        "data_pedido": "Data Pedido",
        "pedido": "Pedido",
        "entregue": "Entregue (sistema)",
        "recebido": "Recebido (NF)",
        "divergencia": "Divergencia",
        "situacao": "Situacao",
    },
    "stock_movement": {
        "produto": "Produto",
        "estoque_atual": "Estoque Atual",
        "entradas": "Entradas",
        "saidas": "Saidas",
        "saldo_do_mes": "Saldo do Mes",
        "alerta": "Alerta",
    },
}
