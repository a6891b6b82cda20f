"""Word lists and tables that the labelers of pii.py look things up in.  Fixed values, as plain text."""

#: Given names, in four languages.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew George Kevin Brian Edward Peter "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Emily Laura Helen Emma Olivia Alice Grace Charlotte Virginia "
    "Hans Peter Wolfgang Klaus Jürgen Dieter Manfred Uwe Günter Horst Bernd Stefan Andreas Matthias Lukas Felix Anna Ursula Monika Petra Sabine Renate Helga Ingrid Greta "
    "Jean Pierre Michel Jacques François Philippe Alain Bernard Nicolas Julien Marie Nathalie Isabelle Sylvie Catherine Françoise Monique Camille Léa Chloé "
    "José Antonio Manuel Francisco Juan Javier Carlos Miguel Pedro Luis Diego Pablo María Carmen Josefa Isabel Ana Dolores Pilar Teresa Lucía Sofía"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Dear Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Don Doña".split()
#: What follows a given name in the names of places, firms and things.
NO_SURNAMES = "Beach City County River Island Street Road Avenue Airport Hospital University College Museum Park Bridge Times Observer Company Corporation Group Bank Hotel Church Square Pepper".split()
#: Types of street that follow the name, or are its end, or come before it.
STREETS = "Street St Road Rd Avenue Ave Lane Drive Boulevard Blvd Court Square Terrace Crescent".split()
STREET_ENDS = "straße strasse gasse weg platz allee ufer".split()
STREETS_BEFORE = "rue avenue boulevard place chemin impasse Calle Avenida Plaza Paseo Camino".split()
#: Length of an IBAN by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28,
    HR=21, HU=28, IE=22, IL=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24,
    RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VG=24, XK=20,
)
#: International dialling codes of one, two and three digits.
DIALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 220 221 225 233 234 237 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 "
    "502 503 504 505 506 507 591 593 595 598 852 855 880 886 961 962 963 964 965 966 968 971 972 973 974 976 977 992 994 995 996 998"
).split()
TOP_DOMAINS = (
    "com org net edu gov mil int info biz io dev app me tv co ai eu uk us ca au nz ie de at ch fr be nl lu es pt it pl cz sk hu ro bg gr dk se no fi is ee lv lt ru ua tr il in cn jp kr br mx ar cl za example"
).split()
#: Values that stand where a secret would.
PLACEHOLDERS = "example sample changeme change_me password passwort secret token undefined required optional placeholder your_ yourtoken xxxx **** none null dummy default redacted insert testtest 12345678 abcdefgh".split()
#: Beginnings of the tokens that some issuers hand out.
ISSUERS = "sk- pk_ ghp_ gho_ xox AKIA ASIA eyJ AIza glpat- hf_ npm_".split()
#: Words of banks and of their codes.
BANKS = "bank bic swift sparkasse volksbank banque banco caja credit kredit iban giro".split()
