"""Lists, patterns and codes that results depend on, as published."""

# fixed values: free mailbox providers
FREE_MAIL = """
gmail.com googlemail.com hotmail.com hotmail.com.br outlook.com outlook.com.br live.com msn.com yahoo.com yahoo.com.br ymail.com
icloud.com me.com aol.com protonmail.com proton.me uol.com.br bol.com.br terra.com.br ig.com.br globo.com globomail.com r7.com
oi.com.br zipmail.com.br superig.com.br brturbo.com.br pop.com.br click21.com.br veloxmail.com.br
""".split()
# fixed values: misspelt providers, providers under any ending, institutions, accountants
TYPO_MAIL = (
    r"^(?:(?:gmai|gmial|gmail|gmil|gmailc|gemail|hotmai|hotmial|homail|hotmal|hotmil|outlok|outook|outlook|otlook|yaho|yahho|uol|bol|terra|ig|globo|iclod|icloud)\.(?:com|com\.br|net|br)"
    r"|(?:gmail|hotmail|outlook|yahoo|icloud|live|terra|uol|bol)\.(?:c[o0]n|cm|om|comm|co|bt|cim|xom|vom))$"
)
FREE_ANY_ENDING = r"^(gmail|googlemail|hotmail|outlook|live|msn|yahoo|ymail|icloud|aol|protonmail)\."
INSTITUTIONAL = r"(\.edu\.br|\.edu|\.ac\.br|oab[a-z]{0,2}\.org\.br|\.jus\.br|\.mil\.br|\.leg\.br|\.g12\.br)$"
ACCOUNTANT = r"(^|[.-])(contab|contabil|assessoria|escritorio|escrit|conta[bd]|fiscal|tributa)"
ACCOUNTANT_WORD = r"(contabilidade|contabeis|contadores|contabil)"

# fixed values: area codes in use
AREA_CODES = """
11 12 13 14 15 16 17 18 19 21 22 24 27 28 31 32 33 34 35 37 38 41 42 43 44 45 46 47 48 49 51 53 54 55 61 62 63 64 65 66 67 68 69 71 73 74
75 77 79 81 82 83 84 85 86 87 88 89 91 92 93 94 95 96 97 98 99
""".split()

# fixed values: states, and marks of a highway's name
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
HIGHWAY = ["BR", "KM", *STATES]
PARTICLES = "de da do das dos e em a o à".split()
ROMAN = r"^(?=[IVXLCDM]{2,}$)M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"

# fixed values: link hubs, free site builders, endings of two labels
LINK_HUBS = """
linktr.ee linktree.com beacons.ai bio.link linkbio.co lnk.bio campsite.bio linkme.bio instagram.com facebook.com fb.com m.facebook.com
wa.me api.whatsapp.com chat.whatsapp.com youtube.com tiktok.com
""".split()
FREE_BUILDERS = """
.wixsite.com .negocio.site .business.site .wordpress.com .blogspot.com .webnode.page .webnode.com.br .weebly.com .jimdosite.com
.godaddysites.com .mystrikingly.com
""".split()
TWO_LABEL_ENDINGS = """
com.br net.br org.br ind.br eco.br cnt.br art.br esp.br adm.br adv.br arq.br eng.br med.br odo.br vet.br psi.br srv.br tur.br agr.br
emp.br blog.br nom.br coop.br gov.br edu.br jus.br mil.br leg.br mp.br com.ar com.pt com.mx com.uy com.py com.co co.uk
""".split()
NOT_A_PROFILE = (
    r"(?i)^/(?:p|reel|reels|tv|stories|s|explore|watch|shorts|video|groups|events|posts|photo|photos|permalink|share|hashtag|marketplace|notes)(?:/|$)"
)

# fixed values: hosts by kind
AGGREGATORS = """
cnpj.biz maiscnpj.com.br baseempresarial.com.br empresasdobrasil.com.br b2bleads.com.br cadastroempresa.com.br cnpj.faix.com.br
faix.com.br cnpjbrasil.com consultacnpjgratis.com.br empresascnpj.com.br cnpj.rocks buscarcnpj.com.br empresas.serasaexperian.com.br
cnpjcerto.com.br cnpja.com cnpj.info cnpjs.rocks casadosdados.com.br econodata.com.br empresascnpj.com consultacnpj.com
cnpjinfo.com.br solutudo.com.br guiamais.com.br apontador.com.br telelistas.net kompass.com empresaqui.com.br
informecadastral.com.br consultasocio.com seudinheiro.net cnpjopen.com receitaws.com.br situacaocadastral.com.br quemsomos.com.br
listamais.com.br encontreinegocios.com.br boaslojas.com.br escavador.com jusbrasil.com.br
""".split()
LEGAL = "jusbrasil.com.br escavador.com jusbrasil.com tjsp.jus.br trf1.jus.br jus.br conjur.com.br migalhas.com.br consultaprocessos.com.br".split()
RESUME = "indeed.com catho.com.br vagas.com.br infojobs.com.br trabalhabrasil.com.br glassdoor.com.br".split()
LINKEDIN = ["linkedin.com", "lnkd.in"]
DOCUMENTS = """
gov.br jus.br oab.org.br scribd.com researchgate.net academia.edu passeidireto.com docplayer.com.br studylib.es yumpu.com issuu.com
slideshare.net dou.gov.br in.gov.br
""".split()
NON_RESULTS = """
google.com google.com.br duckduckgo.com bing.com webcache.googleusercontent.com translate.google.com policies.google.com
support.google.com accounts.google.com
""".split()
NON_BUSINESS = """
mercadolivre.com.br mercadolibre.com olx.com.br enjoei.com.br elo7.com.br shopee.com.br amazon.com.br magazineluiza.com.br
americanas.com.br casasbahia.com.br ifood.com.br rappi.com.br aiqfome.com getninjas.com.br gethelp.com.br airbnb.com.br booking.com
despegar.com.br g1.globo.com globo.com uol.com.br folha.uol.com.br terra.com.br estadao.com.br r7.com band.uol.com.br
metropoles.com cnnbrasil.com.br infomoney.com.br exame.com wikipedia.org wikiwand.com reclameaqui.com.br tripadvisor.com.br
tripadvisor.com yelp.com foursquare.com waze.com sebrae.com.br cnc.org.br fiesp.com.br senai.br sesc.com.br abras.com.br
portaldofranchising.com.br abf.com.br
""".split()
# fixed values: phrases of registry mirrors
REGISTRY_PHRASES = (
    "(situação cadastral|situacao cadastral|dados cadastrais|quadro societário|quadro societario|natureza jurídica|natureza juridica|capital social"
    "|razão social|razao social|é uma empresa de cnpj|e uma empresa de cnpj|consulta de cnpj|consultar cnpj|inscrição estadual|inscricao estadual"
    "|atividade econômica principal|atividade economica principal|data de abertura|cnae fiscal)"
)
CNPJ_SHAPE = r"(\d{2}\.\d{3}\.\d{3}(/\d{4}-\d{2})?|\b\d{14}\b)"
CNPJ_FULL = r"\b(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{14})\b"

# fixed values: words that carry no name
NAME_STOPWORDS = "DE DA DO DAS DOS E DI DU Y".split()
LEADING_CNPJ = r"^\s*\d{2}[.\s]?\d{3}[.\s]?\d{3}(?:[/\s]?\d{4})?(?:[-\s]?\d{2})?\s+"
TRAILING_DIGITS = r"\s+[\d.\-/]{2,}\s*$"

# fixed values: signals in a page's markup
MOUNT_POINTS = r"""(?i)(__NEXT_DATA__|id=["'](?:__next|root|app|__nuxt|q-app)["']|data-reactroot|ng-version=)"""
SHELL_TEXT_CHARS = 400
EXCERPT_CHARS = 8000
MAX_CONTACTS = 8
NOT_A_CONTACT = r"(?i)@(example|test|localhost|sentry|wixpress|squarespace|shopify|godaddy|elementor|wordpress|gravatar|domain|email|yourcompany|empresa|seudominio|site)\b"
ASSET_AT = r"(?i)@\d+x\.|\.(png|jpe?g|gif|svg|webp|css|js|woff2?)$"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
USEFUL_TYPES = """
Organization LocalBusiness ProfessionalService Store Restaurant School EducationalOrganization Corporation Person
HealthAndBeautyBusiness SportsActivityLocation EntertainmentBusiness FinancialService HomeAndConstructionBusiness MedicalBusiness
LegalService AutomotiveBusiness FoodEstablishment LodgingBusiness
""".split()
# fixed values: what makes a page's platform, generators first, then marks in the markup, in this order
GENERATORS = ["wordpress", "wix", "joomla", "drupal"]
PLATFORM_MARKS = [
    ("/wp-content/", "wordpress"), ("/wp-includes/", "wordpress"), ("static.parastorage.com", "wix"), ("wix.com", "wix"), ("squarespace", "squarespace"),
    ("shopify", "shopify"), ("cdn.jsdelivr.net/npm/vue", "vue"), ("__nuxt", "vue"), ("__next", "nextjs"),
]
# fixed values: hosts whose every address is a conversation
CHAT_HOSTS = ["wa.me", "api.whatsapp.com", "chat.whatsapp.com"]
# fixed values: links worth following first
INTERESTING = (
    "(?iu)(contato|contatos|contact|fale-conosco|fale-com|falecom|atendimento|suporte|ajuda|sobre|sobre-nos|quem-somos|institucional|empresa|servicos|serviços|produtos"
    "|solucoes|soluções|planos|precos|preços|orcamento|orçamento|unidades|filiais|lojas|onde-estamos|localizacao|localização|trabalhe)"
)
FILE_ENDING = r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|mp4|mp3)$"
# fixed values: street types and their short forms
STREET_TYPES = dict(x.split("=") for x in """
r=RUA rua=RUA av=AVENIDA avenida=AVENIDA al=ALAMEDA alameda=ALAMEDA tv=TRAVESSA trav=TRAVESSA travessa=TRAVESSA pc=PRACA praca=PRACA rod=RODOVIA rodovia=RODOVIA
estr=ESTRADA estrada=ESTRADA lgo=LARGO largo=LARGO vl=VILA vila=VILA jd=JARDIM jardim=JARDIM mar=MARGINAL via=VIA
""".split())
# fixed values: walls before a profile page
WALL_PATHS = [("(?i)^/checkpoint/", "checkpoint"), ("(?i)^/(authwall|uas/login|login|signup)", "auth"), ("(?i)/unavailable/?$", "gone")]
AUTH_TEXT = "(?iu)(entre para ver|fa(ç|c)a login para ver|junte-se ao linkedin|sign in to view|join linkedin to view|to view .{0,30}profile|cadastre-se para ver)"
CHECKPOINT_TEXT = "(?iu)(verifica(ç|c)(ão|ao) de seguran(ç|c)a|security verification|confirme que (é|e) voc(ê|e)|unusual activity|atividade incomum|vamos fazer uma verifica)"
GONE_TEXT = "(?iu)(esta p(á|a)gina n(ã|a)o existe|this page doesn'?t exist|p(á|a)gina n(ã|a)o encontrada|page not found)"
# fixed values: how a page states a company's size
STAFF = r"(?:funcion(?:á|a)rios|employees|colaboradores)"
STAFF_RANGE = r"(?iu)([\d.,]+)\s*[-–]\s*([\d.,]+)\s*" + STAFF
STAFF_OPEN = r"(?iu)([\d.,]+)\s*\+\s*" + STAFF
STAFF_ABOVE = r"(?iu)(?:mais de|acima de|over|more than)\s*([\d.,]+)\s*" + STAFF
STAFF_ON_SITE = r"(?iu)([\d.,]+)\s*(?:funcion(?:á|a)rios|employees|associados)\s*(?:no|on|at)\s*linkedin"
FOLLOWERS = r"(?iu)([\d.,]+)\s*(?:seguidores|followers)"
# fixed values: search pages that hold no results
DDG_BLOCKED = "(?i)(anomaly[_-]?modal|challenge-form|If this error persists|unusual traffic|blocked)"
DDG_EMPTY = r"(?i)(no-results|No results\.|Nenhum resultado)"
GOOGLE_BLOCKED = r"""(?iu)(Our systems have detected unusual traffic|tráfego incomum|nossos sistemas detectaram|id="captcha-form"|action="/sorry/index"|\bunusual traffic from your computer\b)"""
GOOGLE_CONSENT = """(?i)(id="?consent-bump|antes de continuar (?:no|para o) Google|Before you continue to Google)"""
GOOGLE_EMPTY = "(?iu)(did not match any documents|não encontrou nenhum documento|Nenhum documento|No results found)"
# fixed values: network errors in words
FETCH_ERRORS = {
    "ENOTFOUND": "domínio não existe", "ECONNREFUSED": "conexão recusada", "ECONNRESET": "conexão interrompida pelo servidor", "ETIMEDOUT": "servidor não respondeu",
    "EAI_AGAIN": "falha de DNS", "CERT_HAS_EXPIRED": "certificado HTTPS vencido", "DEPTH_ZERO_SELF_SIGNED_CERT": "certificado HTTPS não confiável",
    "SELF_SIGNED_CERT_IN_CHAIN": "certificado HTTPS não confiável", "UNABLE_TO_VERIFY_LEAF_SIGNATURE": "certificado HTTPS incompleto",
}
