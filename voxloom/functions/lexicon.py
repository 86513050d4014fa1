"""Language resources as data: markers, register words, preferences, pronouns, word sets, and the rules that go with them.

A marker is written as ``label = form``. A form is a list of words or phrases separated by "/", which have to stand alone:
letters, digits and apostrophes are part of a word. Before it may stand ``^`` (only at the start or after a comma, semicolon or
colon); behind it, in braces, a regular expression that has to follow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

EDGE_BEFORE, EDGE_AFTER = r"(?<![\w'’])", r"(?![\w'’])"
AT_START, AT_END = r"(?:^|[,;:] )", r"[ ,.!…]*$"

# The marker tables, French and English.
FR_MARKERS = r"""
[discourse_markers]
voilà = voilà/voila
alors = alors
donc = donc
bon = ^bon{(?=[,.!…]|$| (?:voilà|alors|ben|bah|eh|écoutez|on|je|j'|là|ok|allez|après|ça|maintenant|donc|et)\b)}
allez = ^allez
du coup = du coup
en fait = en fait
bref = bref
ben / bah = ben/bah/eh ben/eh bien
hein = hein
quoi (final) = quoi{END}
ok / d'accord = ok/okay/d'accord
ouais = ouais
attention = attention
là (deictic) = là
[transitions]
ensuite = ensuite
puis = puis/et puis
après (initial) = ^(?:et |donc )?|après
maintenant = maintenant
d'abord = d'abord/tout d'abord/premièrement
et là = et là/et puis là
une fois que = une fois que/une fois qu'
pendant ce temps = pendant ce temps/pendant que
pour finir = pour finir/pour terminer/pour conclure/dernière étape
[hedging]
un peu = un peu/un petit peu
à peu près / environ / plus ou moins = à peu près/environ/plus ou moins/grosso modo
peut-être = peut-être/peut être
je pense / je crois / je trouve = je pense/je crois/je trouve
on va dire = on va dire/disons
normalement / en général = normalement/en général/généralement
si vous voulez / préférez / aimez = si vous voulez/si vous préférez/si vous aimez/comme vous voulez
genre / une sorte de / une espèce de = genre/une sorte de/une espèce de
[intensifiers]
vraiment = vraiment
très = très
bien (+adj) = bien{ (?=\w+(?:é|ée|és|ées|ant|ante|ants|antes|eux|euse|if|ive|ible|able|ide)\b)}
super / hyper / ultra = super/hyper/ultra
extrêmement / énormément / tellement = extrêmement/énormément/tellement
absolument / complètement / parfaitement = absolument/complètement/parfaitement/totalement
carrément / vachement = carrément/vachement
trop = trop
[contrast_qualification]
mais = mais
par contre / en revanche = par contre/en revanche
quand même = quand même
sauf que = sauf que/sauf qu'/sauf si
même si = même si/même s'
pourtant / cependant = pourtant/cependant/néanmoins/toutefois
c'est-à-dire = c'est-à-dire/c'est à dire
[audience_framing]
vous voyez / tu vois = vous voyez/tu vois/vous avez vu/t'as vu/tu as vu
regardez / regarde = regardez/regarde/voyez
je vous montre / explique = je vous montre/je vais vous montrer/je vous explique/je vais vous expliquer
je vous conseille / recommande = je vous conseille/je vous recommande/je vous invite
vous allez / pouvez / verrez = vous allez/vous pouvez/vous pourrez/vous verrez
n'hésitez pas = n'hésitez pas
on va (inclusive) = on va
c'est parti / on y va / hop = c'est parti/on y va/allez hop/et hop/hop
[repair]
enfin (repair) = \w |enfin{(?!,? (?:bref|voilà))}
je veux dire / pardon / ou plutôt = je veux dire/pardon/ou plutôt/non mais
[evaluative]
magnifique / superbe / sublime = magnifique/superbe/sublime/splendide
extraordinaire / incroyable = extraordinaire/incroyable/exceptionnel/exceptionnelle
génial / top / nickel / parfait = génial/géniale/top/nickel/excellent/excellente/parfait/parfaite
délicieux / succulent / une tuerie = délicieux/délicieuse/succulent/succulente/un régal/une tuerie/une merveille
c'est (très) bon = c'est bon/c'est très bon/trop bon/très bon
wow = wow/waouh/whaou/oh là là/ouh là
[channel]
abonnez-vous / like / commentaires = abonn\w*/like/pouce/commentaire/commentaires/la cloche
"""
EN_MARKERS = r"""
[discourse_markers]
so (initial) = ^so{(?=[, ]|$)}
well (initial) = ^well{(?=[,.!]|$)}
you know = you know{(?! (?:what|how|why|that|the|a|it)\b)}
I mean = i mean
like (filler) = (?:,|^) ?|like{,? }
actually = actually
basically / literally = basically/literally
okay / alright = ok/okay/alright/all right
right (tag) = right{ ?[?,]}
now (initial) = ^now{(?=,| )}
look / listen = ^look/listen{(?=[,.!]| )}
anyway = anyway/anyways
oh = oh
yeah = yeah/yep/yup
[transitions]
then / and then = then/and then
next = next
after that = after that/afterwards
first = ^first/firstly/first of all
finally = finally/lastly/in the end
meanwhile = meanwhile/in the meantime
once = ^once
[hedging]
kind of / sort of = kind of/sort of/kinda/sorta
a bit / a little = a bit/a little/a little bit
maybe / perhaps / probably = maybe/perhaps/probably
I think / I guess = i think/i guess/i feel like/i suppose/i reckon
pretty much / more or less = pretty much/more or less/roughly
if you want = if you want/if you like/if you prefer
[intensifiers]
really = really
very = very
so (+adj) = so{ (?=\w+(?:ful|ous|ive|able|ible|ing|ed|y|ic|al)\b)}
super / totally = super/totally/utterly
absolutely / completely = absolutely/completely/perfectly/entirely
extremely / incredibly = extremely/incredibly/hugely/massively
too = too{(?! ?[.,!?]|$)}
[contrast_qualification]
but = but
however = however/nevertheless/nonetheless
though / although = though/although/even though
still (initial) = ^still
on the other hand = on the other hand/whereas/instead
that said = that said/having said that/mind you
[audience_framing]
you see / you'll see = you see/you'll see/you can see
let me show you = let me show you/i'll show you/i'm gonna show you/i'm going to show you/let me explain
you can / you could = you can/you could/you might/you're gonna/you're going to
let's = let's/let us
make sure / don't forget = make sure/don't forget/remember
trust me / believe me = trust me/believe me/i promise
[repair]
sorry / or rather = or rather/sorry/what i mean is
[evaluative]
amazing / incredible = amazing/incredible/unbelievable/insane
great / fantastic / brilliant = great/fantastic/brilliant/excellent/awesome/terrific
beautiful / lovely / gorgeous = beautiful/lovely/gorgeous/stunning
perfect = perfect/spot on
delicious / tasty = delicious/tasty/yummy
wow = wow/whoa/oh my god/oh my gosh
[channel]
subscribe / like / comment = subscrib\w*/like this video/hit the bell/comment below/the comments
"""
# The other tables.
FR_FAMILIAR = "ouais bah ben truc trucs machin super génial nickel top tuerie sympa hyper vachement bouffe mec pote boulot galère cool kiffer kif ouf dingue chiant bordel putain fringues flic fric".split()
EN_FAMILIAR = "gonna/wanna/gotta/kinda/sorta/yeah/yep/nope/stuff/guys/awesome/cool/dude/ain't/y'all/folks/mate/bloody/crap/freaking/cos/lots of/a bunch of/loads of".split("/")
FR_PREFERENCES = "on = on : nous = nous\nça = ça/ç' : cela = cela\nvous = vous : tu = tu/t'/toi\ntu = tu/t'/toi : vous = vous"
EN_PREFERENCES = """yeah = yeah/yep/yup : yes = yes
gonna = gonna : going to = going to{(?! the| a\\b| my| your)}
wanna = wanna : want to = want to
I'm = i'm : I am = i am
it's = it's : it is = it is
you = you : one (generic) = one{ (?=can|should|must|might|would|could|has|needs)}"""


@dataclass(frozen=True)
class Lexicon:
    code: str
    name: str
    markers: str
    familiar: list
    preferences: str
    address: str
    first_person: str
    pronouns: list
    tags: str
    negation: str
    imperative: str
    imperative_after: frozenset
    emphatic: frozenset
    repeat_ok: frozenset
    grammar_words: frozenset
    formal_connectors: list
    space_before_marks: bool
    text: dict
    negation_words: frozenset = frozenset()
    ne: frozenset = frozenset()
    imperative_endings: tuple = ()
    imperative_stop: frozenset = frozenset()
    imperative_display: dict = field(default_factory=dict)


def standalone(form: str) -> str:
    """The pattern of words or phrases that have to stand alone."""
    return f"{EDGE_BEFORE}(?:{'|'.join(form.split('/'))}){EDGE_AFTER}"


def pattern(form: str) -> str:
    """The pattern of a form; Unicode-aware in Java with the flag java_pattern adds."""
    tail = ""
    if m := re.search(r"\{(.*)\}$", form):
        form, tail = form[: m.start()], AT_END if m[1] == "END" else m[1]
    lead = ""
    if "|" in form and not form.startswith("^|"):
        lead, form = form.rsplit("|", 1)
        if lead.startswith("^"):
            lead = AT_START + lead[1:]
    elif form.startswith("^"):
        lead, form = AT_START, form[1:]
    return lead + standalone(form) + tail


def java_pattern(p: str) -> str:
    return "(?U)" + p


def markers(lexicon: Lexicon) -> list[tuple[str, str, str]]:
    """(category, label, form) in order."""
    out, category = [], ""
    for line in lexicon.markers.strip().splitlines():
        if line.startswith("["):
            category = line[1:-1]
        else:
            label, form = line.split(" = ", 1)
            out.append((category, label, form))
    return out


def preferences(lexicon: Lexicon) -> list[tuple[str, str, str, str]]:
    """(use, its form, avoid, its form)."""
    out = []
    for line in lexicon.preferences.splitlines():
        use, avoid = line.split(" : ", 1)
        out.append((*use.split(" = ", 1), *avoid.split(" = ", 1)))
    return out


FRENCH = Lexicon(
    "fr", "French", FR_MARKERS, FR_FAMILIAR, FR_PREFERENCES, "vous/votre/vos/tu/t'/toi/ton/ta/tes", "je",
    "je j' moi tu t' toi vous on nous il elle ils elles ça ç' cela ce c'".split(),
    r"(?:d'accord|ok|okay|hein|non|vous voyez|tu vois|n'est-ce pas|voilà|oui)\s*\?\s*$", "fr_ne", "fr_endings",
    frozenset("et puis alors donc allez bon n' ne".split()), frozenset("très vraiment bien trop non oui si tout beaucoup".split()), frozenset(("vous", "nous")),
    frozenset("il y a que qu' j' ai et c' c'est est avec de l' vous êtes ce si avez la le les un une à en je on ça des du d' qui".split()),
    ["cependant", "néanmoins", "en outre", "ainsi", "par conséquent"], True,
    dict(negation_card="In {freq} of the negations *ne* is swallowed (« j'sais pas », « y a pas »); elsewhere it is spoken.", too_formal="The draft says every « ne »; this voice swallows many of them (« j'sais pas »).", too_casual="The draft swallows « ne » where this voice mostly speaks it.", negation_label="negations in which *ne* is spoken", chain_words="« et », « donc », « là »", fragment="« Voilà. »"),
    frozenset("pas jamais rien personne aucun aucune guère".split()), frozenset(("ne", "n'", "n’")), ("ez", "ons"),
    frozenset("chez assez nez rez avez êtes savez voulez pouvez devez avons sommes savons voulons pouvons devons".split()),
    {"allez": "Allez", "écoutez": "Écoutez", "regardez": "Regardez", "attendez": "Attendez", "hésitez": "N'hésitez pas", "imaginez": "Imaginez", "pensez": "Pensez à…"},
)
ENGLISH = Lexicon(
    "en", "English", EN_MARKERS, EN_FAMILIAR, EN_PREFERENCES, "you/your/yours/yourself/yourselves/you're/you'll/you've/you'd", "i",
    "i me my you your we us our he she they it this that one".split(),
    r"(?:right|okay|ok|yeah|you know|isn't it|aren't you|don't you|huh|eh)\s*\?\s*$", "en_contraction", "en_base",
    frozenset("and so now just then please okay ok alright well oh first next but".split()), frozenset("very really so too no yes much more never way".split()), frozenset(("that", "had", "is")),
    frozenset("i you it is it's the a an and of to in that this we be have do don't i'm you're on for with so but what there there's if can just are was at 's 'm 're n't".split()),
    ["furthermore", "moreover", "therefore", "consequently", "thus", "hence", "whereby"], False,
    dict(negation_card="*not* shrinks to *n't* in {freq} of the negations (*won't*, *couldn't*).", too_formal="The draft spells *not* out; this voice shrinks it (won't, couldn't).", too_casual="The draft shrinks *not* everywhere; this voice often gives it a word of its own.", negation_label="negations in which *not* is a word of its own", chain_words='"and", "so", "then"', fragment='"Right."'),
)
LEXICONS = {"fr": FRENCH, "en": ENGLISH}
# Rhetorical devices, what they are called in a passage, and how languages are spelled.
DEVICES = "rhetorical_question contrast analogy anecdote emphatic_repetition list reframing provocative_opening counterargument humor authority".split()
PASSAGE_DEVICES = "counterargument anecdote reframing humor authority rhetorical_question contrast analogy".split()
LANGUAGE_NAMES = {"en": ("en", "english", "eng"), "fr": ("fr", "french", "français", "fra", "fre")}
FUNCTION_WORDS = {
    "en": "the and of to a in is was it that we i you they he she my with for on at but not have had what who there this so nobody because before were are be",
    "fr": "le la les un une des du de et est était il elle on je vous nous ils elles mais pas ne n l d j qu c s que qui dans sur avec pour ce cette au aux sans",
    "es": "el la los las un una de del y es era que en por con para pero no se yo ella nosotros ellos mi al lo su como más muy",
    "de": "der die das den dem des ein eine einen einem und ist war ich wir sie er es nicht mit für auf an im am zu von aber dass hat haben wie was",
    "it": "il lo la i gli le un una di del della e è era che in per con ma non si io noi lei loro mio al nel sul da come più",
    "pt": "o a os as um uma de do da dos das e é era que em no na por com para mas não se eu ela nós eles meu ao você como mais muito",
}
