"""Rule tables of the radar. All of them can be replaced by job parameters.

Fixed values: the words, weights and labels below are part of the results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TOPIC_RULES = {
    "preço": ("preco", "promocao", "oferta", "desconto", "r$"),
    "reputação": ("reclamacao", "reclame", "avaliacao", "nota", "queixa"),
    "atendimento": ("atendimento", "fila", "demora", "suporte", "servico"),
    "expansão": ("inaugur", "nova unidade", "nova loja", "expansao", "filial"),
    "digital": ("app", "aplicativo", "delivery", "e-commerce", "ecommerce", "plataforma"),
    "marketing": ("campanha", "publicidade", "patrocin", "evento", "marketing"),
    "pessoas": ("vaga", "contratacao", "emprego", "recrut", "funcionario"),
    "regulação": ("procon", "multa", "fiscalizacao", "sanitaria", "anvisa", "processo"),
    "produto": ("produto", "lancamento", "catalogo", "servico", "cardapio"),
    "parceria": ("parceria", "acordo", "joint venture", "fornecedor"),
}

PRIORITY_DOMAINS = {
    "gov.br": 1.00,
    "reclameaqui.com.br": 0.95,
    "procon": 0.95,
    "g1.globo.com": 0.92,
    "cidadeverde.com": 0.92,
    "portalodia.com": 0.90,
    "meionews.com": 0.88,
    "mppi.mp.br": 0.98,
}

TRUSTED_DOMAINS = ("gov.br", "mppi.mp.br", "reclameaqui.com.br", "g1.globo.com")

FOREIGN_CITIES = (
    "jundiai", "cubatao", "redmond", "washington", "new york", "california", "florida",
    "texas", "miami", "los angeles", "london", "madrid", "lisboa", "paris",
)

HOMONYM_PHRASES = (
    "loja de ferramentas", "ferramentas",
    "material de construcao",
)

# Event kind -> base weight.
EVENT_BASE = {
    "PREÇO": 60, "REPUTAÇÃO": 62, "ATENDIMENTO": 54, "EXPANSÃO": 74, "DIGITAL": 62,
    "MARKETING": 48, "PESSOAS": 44, "REGULAÇÃO": 78, "PRODUTO/SERVIÇO": 52, "PARCERIA": 50,
}

# Event kind -> words, in the order in which kinds are tried.
EVENT_WORDS = {
    "REGULAÇÃO": ("procon", "multa", "fiscalizacao", "anvisa", "vigilancia sanitaria"),
    "PESSOAS": ("vaga", "emprego", "contratacao", "recrutamento", "processo seletivo"),
    "EXPANSÃO": (
        "inaugur", "nova unidade", "nova loja", "expansao", "filial", "abre as portas",
        "instalacao de", "vai abrir", "planeja abrir",
    ),
    "REPUTAÇÃO": ("reclamacao", "reclame aqui", "queixa", "avaliacao", "nota"),
    "ATENDIMENTO": ("fila", "demora no atendimento", "mau atendimento", "suporte"),
    "PREÇO": ("preco", "oferta", "promocao", "desconto"),
    "DIGITAL": ("app", "aplicativo", "delivery", "e-commerce", "ecommerce", "plataforma", "supershop"),
    "MARKETING": ("campanha", "publicidade", "patrocin", "marketing", "evento promocional"),
    "PRODUTO/SERVIÇO": (
        "lancamento", "produto novo", "novo produto", "cardapio", "catalogo", "servico",
    ),
    "PARCERIA": ("parceria", "acordo", "joint venture", "fornecedor"),
}
# Words that add the expansion dimension to a staffing event.
STAFFING_EXPANSION_WORDS = ("nova unidade", "nova loja", "inaugur", "filial")
# Words of which both titles of one regulation event must hold one.
REGULATION_WORDS = ("procon", "multa", "fiscalizacao", "anvisa", "sanitaria", "processo")

RISK_KINDS = ("REPUTAÇÃO", "ATENDIMENTO", "REGULAÇÃO")
OPPORTUNITY_KINDS = ("PREÇO", "EXPANSÃO", "DIGITAL", "MARKETING", "PRODUTO/SERVIÇO", "PARCERIA")

ACTIVITY_WEIGHTS = {
    "PREÇO": 0.12, "EXPANSÃO": 0.16, "DIGITAL": 0.12, "MARKETING": 0.08, "PRODUTO/SERVIÇO": 0.10,
    "PARCERIA": 0.05, "REPUTAÇÃO": 0.14, "ATENDIMENTO": 0.08, "REGULAÇÃO": 0.08, "PESSOAS": 0.07,
}

ACTIONS = {
    "PREÇO": "Medir preço/promoção em itens sensíveis antes de alterar margem.",
    "REPUTAÇÃO": "Quantificar recorrência e gravidade antes de tratar o tema como estrutural.",
    "ATENDIMENTO": "Monitorar por unidade/canal e criar KPI operacional.",
    "EXPANSÃO": "Mapear raio de impacto e comparar oferta/concorrência local.",
    "DIGITAL": "Comparar jornada, aquisição e conveniência digital.",
    "MARKETING": "Mapear mensagem, público e timing antes de reagir.",
    "PESSOAS": "Separar expansão de reposição antes de inferir crescimento.",
    "REGULAÇÃO": "Validar o ato diretamente em fonte oficial.",
    "PRODUTO/SERVIÇO": "Comparar mix, lançamento e proposta de valor.",
    "PARCERIA": "Avaliar impacto em distribuição, canal, tecnologia ou aquisição.",
}
DEFAULT_ACTION = "Investigar o evento antes de agir."

GAPS = {
    "PREÇO": "Não há comparação confiável de preço suficiente nesta execução.",
    "REPUTAÇÃO": "Não há amostra suficiente para inferir tendência de reputação.",
    "EXPANSÃO": "Não há evidência suficiente de expansão recente.",
}
NO_DATE_GAP = "A maior parte das evidências não possui data verificável."
NO_GAP = "Não foram detectadas lacunas críticas nas dimensões monitoradas."

# Words that speak against a price: finance and jobs.
NOT_A_PRICE_WORDS = (
    "pib", "receita", "lucro", "investimento", "caixa", "milhoes", "bilhoes", "cotacao",
    "dividend", "acoes", "salario", "vaga", "emprego", "patrimonio",
)

OFFICIAL_SHOP_WORDS = (
    "comprar online", "loja online", "loja virtual", "catalogo", "produtos", "ofertas",
    "precos", "supershop", "ecommerce",
)
ANCHOR_SHOP_WORDS = (
    "comprar", "loja", "shop", "supermarket", "supershop", "produto", "oferta", "catalogo",
    "preco", "servicos", "cardapio", "menu", "reservar",
)
TEXT_PRICE_WORDS = (
    "comprar", "carrinho", "produto", "oferta", "promocao", "preco", "servico", "cardapio", "reservar",
)


@dataclass(frozen=True)
class PageRules:
    """What makes a URL or a page commercial."""

    path_hints: tuple[str, ...] = (
        "product", "products", "service", "services", "offer", "offers", "catalog", "catalogue",
        "plan", "plans", "price", "pricing",
    )
    negative_hints: tuple[str, ...] = (
        "news", "noticia", "noticias", "article", "blog", "career", "careers", "employment", "emprego",
    )
    content_hints: tuple[str, ...] = (
        "add to cart", "buy now", "offer", "product", "service", "catalog", "price", "reserve",
    )
    schema_types: tuple[str, ...] = ("product", "service", "offer", "aggregateoffer")
    blocked_domains: tuple[str, ...] = ()
    anchor_words: tuple[str, ...] = ANCHOR_SHOP_WORDS
    official_words: tuple[str, ...] = OFFICIAL_SHOP_WORDS
    candidate_score: float = 0.45
    external_link_score: float = 0.70
    home_paths: tuple[str, ...] = ("", "/", "/home", "/index.html", "/index.php")


@dataclass(frozen=True)
class RadarProfile:
    """The company watched and what counts as being about it."""

    company: str
    aliases: tuple[str, ...] = ()
    city: str = ""
    state: str = ""
    market: str = "mercado"
    homonyms: tuple[str, ...] = ()
    foreign_cities: tuple[str, ...] = FOREIGN_CITIES
    topics: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(TOPIC_RULES))
    priority_domains: dict[str, float] = field(default_factory=lambda: dict(PRIORITY_DOMAINS))
    min_history_year: int = 2020
    min_current_year: int = 2025
