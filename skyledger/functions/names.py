"""Names of kinds and constellations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the catalogue's kinds are called.
KINDS = {
    "G": "Galaxy", "GPair": "Galaxy pair", "GTrpl": "Galaxy triplet", "GGroup": "Galaxy group", "OCl": "Open cluster", "GCl": "Globular cluster", "Cl+N": "Cluster with nebula", "*Ass": "Stellar association",
    "PN": "Planetary nebula", "HII": "Emission nebula (HII region)", "EmN": "Emission nebula", "RfN": "Reflection nebula", "DrkN": "Dark nebula", "Neb": "Nebula", "SNR": "Supernova remnant", "Nova": "Nova", "*": "Star", "**": "Double star",
}
# The IAU's abbreviations of the constellations.
CONSTELLATIONS = dict(pair.split("=") for pair in (
    "And=Andromeda Ant=Antlia Aps=Apus Aqr=Aquarius Aql=Aquila Ara=Ara Ari=Aries Aur=Auriga Boo=Boötes Cae=Caelum Cam=Camelopardalis Cnc=Cancer CVn=Canes_Venatici CMa=Canis_Major CMi=Canis_Minor Cap=Capricornus "
    "Car=Carina Cas=Cassiopeia Cen=Centaurus Cep=Cepheus Cet=Cetus Cha=Chamaeleon Cir=Circinus Col=Columba Com=Coma_Berenices CrA=Corona_Australis CrB=Corona_Borealis Crv=Corvus Crt=Crater Cru=Crux Cyg=Cygnus "
    "Del=Delphinus Dor=Dorado Dra=Draco Equ=Equuleus Eri=Eridanus For=Fornax Gem=Gemini Gru=Grus Her=Hercules Hor=Horologium Hya=Hydra Hyi=Hydrus Ind=Indus Lac=Lacerta Leo=Leo LMi=Leo_Minor Lep=Lepus Lib=Libra "
    "Lup=Lupus Lyn=Lynx Lyr=Lyra Men=Mensa Mic=Microscopium Mon=Monoceros Mus=Musca Nor=Norma Oct=Octans Oph=Ophiuchus Ori=Orion Pav=Pavo Peg=Pegasus Per=Perseus Phe=Phoenix Pic=Pictor Psc=Pisces "
    "PsA=Piscis_Austrinus Pup=Puppis Pyx=Pyxis Ret=Reticulum Sge=Sagitta Sgr=Sagittarius Sco=Scorpius Scl=Sculptor Sct=Scutum Ser=Serpens Sex=Sextans Tau=Taurus Tel=Telescopium Tri=Triangulum "
    "TrA=Triangulum_Australe Tuc=Tucana UMa=Ursa_Major UMi=Ursa_Minor Vel=Vela Vir=Virgo Vol=Volans Vul=Vulpecula"
).split())


def kind_name(kind: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, kind), F.lit("Other"))


def constellation_name(short: Column) -> Column:
    """The name of an abbreviation; the two parts of Serpens (Se1, Se2) are one."""
    named = F.create_map(*[F.lit(x) for k, v in CONSTELLATIONS.items() for x in (k, v.replace("_", " "))])
    return F.try_element_at(named, F.when(short.isin("Se1", "Se2"), "Ser").otherwise(short))
