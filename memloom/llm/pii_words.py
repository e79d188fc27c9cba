"""General words of English, German, French and Spanish that stand around personal information."""

from __future__ import annotations

TITLES = {"en": "Mr. Mrs. Ms. Dr. Prof. Mr Mrs Dr".split(), "de": "Herr Frau Dr. Prof. Herrn".split(), "fr": "M. Mme Dr. Monsieur Madame".split(), "es": "Sr. Sra. Dr. Don Doña".split()}
#: What people say and do, in forms that follow a name.
SAYING = {
    "en": """said says wrote writes asked asks wants wanted thinks thought joined left called agreed replied sent lives works has had is was will would can could should moved resigned retired knows knew found
    likes likes signed answered reported noticed owns runs leads manages told gave got took made met paid read does did may must became goes came went needs bought forgot lost won refused declined denied""".split(),
    "de": "sagte sagt schrieb fragte will wollte denkt ging kam rief hat hatte ist war wird wohnt arbeitet möchte kennt fand meint kaufte vergaß verlor kann soll antwortete unterschrieb".split(),
    "fr": "a est était dit veut habite travaille pense connaît demande écrit va vient sera peut doit avait prend garde oublie répond signe déménage".split(),
    "es": "ha es era dijo quiere vive trabaja piensa conoce pregunta escribe va viene será puede debe había toma olvidó perdió responde firmó llamó está".split(),
}
#: What precedes a person who is spoken to or about.
ADDRESSING = {
    "en": """ask tell thank call phone ping email contact meet met invite remind cc with by from to for of per hire warn help visit see saw know knew married told asked thanked called invited hired paid congratulate
    welcome about without in met loop introduce assign assigned between behind like and trust message notify""".split(),
    "de": "frag fragen Sie ruf grüß triff mit von an für bei ohne über und kenne heißt traf".split(),
    "fr": "demandez appelez remerciez voyez avec par pour de chez sans et connais appelle".split(),
    "es": "pregunta llama avisa conoce con por para de a sin y visita llamé saluda".split(),
}
ROLES = {
    "en": """manager colleague owner author reviewer contact engineer nurse customer client patient tenant teacher neighbour landlord lawyer accountant captain winner guest caller name assignee boss friend sister brother mother father
    wife husband daughter son cousin uncle aunt driver doctor professor director editor chef coach employee student witness plumber assistant chairman secretary sender recipient""".split(),
    "de": "Chef Kollege Nachbar Kundin Vermieter Lehrerin Ärztin Hausmeister Freund Schwester Bruder Mutter Vater Name Autor Fahrer".split(),
    "fr": "collègue voisin directeur cliente propriétaire médecin ami sœur frère mère père nom auteur avocat".split(),
    "es": "jefe colega vecino cliente dueño profesora médico amigo hermana hermano madre padre nombre autor abogada".split(),
}
#: What bears names without being a person.
THINGS = frozenset(
    """gateway service server system module pipeline router index cluster database project release version metric team group app tool suite api client plugin dashboard branch harbor engine store cache queue node
    company bank hotel museum school festival bridge river station airport valley forest league library church market brand series model board council fund archive club plan act award cup edition item
    framework package platform portal network protocol agent worker job task report page file test item row""".split()
)
_flat = lambda d: frozenset(w.lower() for ws in d.values() for w in ws)
SAYING_ANY, ADDRESSING_ANY, ROLES_ANY = _flat(SAYING), _flat(ADDRESSING), _flat(ROLES)
TITLES_ANY = frozenset(w.rstrip(".") for w in _flat(TITLES)) | {"herrn", "señor", "señora", "docteur", "monsieur", "madame", "signor", "senhor"}
DETERMINERS = frozenset("the a an this that these those our my your his her their its each every some any no der die das den dem des ein eine einen einem einer mein meine meinen unser unsere dein sein seine ihr ihre le la les un une des ce cette notre mon ma el los las una unos este esta nuestro mi su il lo het de".split())
PLACE = frozenset("in at near into towards around toward across through nach aus bei zu vers dans en hacia desde hasta".split())
GREETING = frozenset("hello hi dear regards thanks thank best wishes cheers sincerely yours hallo liebe lieber grüße grüßen gruß bonjour cher chère cordialement merci hola querido querida saludos gracias atentamente am i'm is heiße bin suis m'appelle llamo soy".split())
WHO = frozenset("who whose whom der die wer qui dont que quien cuyo".split())
AND = frozenset("and und et y e or oder ou o".split())
#: Words that are capitalised in headings and instructions.
HEADING = frozenset(
    """open close visit read write run start stop check add remove update create delete install click select call buy see use try show move copy save merge push pull test plan watch join request guide notes report chapter section
    table figure page release changes settings template overview basics summary review status week day morning project list order number version new north south east west central great saint united national general city
    county lake mount river road park bridge museum university bank station square first second third last quick getting machine data open source figure step error user story room bus main results way""".split()
)
