"""Keyword packs: named lists of substrings of procurement texts, for ``tagging.pack_terms``."""

#: Terms of each pack (fixed values).
PACKS = {
    "radiological": [
        "glovebox", "argon glovebox", "inert atmosphere glovebox", "hot cell", "shielded cell", "shielded enclosure", "shielded room", "shielded door", "lead-lined", "lead lined",
        "lead shielding", "neutron shielding", "gamma shielding", "x-ray shielding", "borated polyethylene", "high density concrete", "tungsten shielding", "health physics",
        "radiation protection", "radiation safety", "radiological control", "radiological controls", "contamination control", "decontamination", "dosimetry", "personnel dosimetry",
        "radiation survey", "survey meter", "wipe test", "smear test", "portal monitor", "whole body counter", "radioactive material", "sealed source", "unsealed source",
        "byproduct material", "source material", "special nuclear material", "fissile material", "criticality safety", "material control and accountability", "mc&a", "tritium",
        "uranium", "plutonium", "radioisotope", "isotope production", "10 cfr 20", "10 cfr 30", "10 cfr 70", "10 cfr 71", "10 cfr 73", "10 cfr 74", "10 cfr 835",
    ],
    "secure_areas": [
        "special access program facility", "top secret/sci", "dd254", "need-to-know", "classified processing", "classified information", "closed area", "open storage area",
        "secure vault", "gsa class 5", "class 5 vault", "jsig", "joint special access program implementation guide",
    ],
    "shielding_emsec": [
        "tempest", "emsec", "emission security", "rf shielding", "rf shielded", "emi shielding", "electromagnetic shielding", "faraday cage", "shielded enclosure", "shielded room",
        "waveguide", "honeycomb vent", "shielded penetration", "acoustic attenuation", "sound attenuation", "acoustic treatment",
    ],
    "access_control": [
        "physical access control system", "access control system", "badge reader", "card reader", "credential reader", "biometric access", "fingerprint reader", "iris scanner",
        "two-factor access", "mantrap", "turnstile", "door controller", "electric strike", "magnetic lock", "mag lock", "security vestibule", "intercom", "video intercom", "cctv",
        "video surveillance", "security camera", "intrusion detection system", "alarm monitoring", "duress alarm", "hspd-12", "piv card", "fips 201", "common access card", "cac card",
    ],
    "controlled_environments": [
        "cleanroom", "clean room", "iso class", "gowning", "gowning room", "air shower", "airlock", "anteroom", "ante-room", "pressure cascade", "negative pressure",
        "positive pressure", "hepa filtration", "hepa filter", "ulpa filter", "laminar flow", "vibration isolation", "humidity control", "dew point control",
        "temperature stability", "dry room", "nitrogen purge", "inert atmosphere",
    ],
    "facilities_construction": [
        "design-build", "design build", "renovation", "build-out", "build out", "fit-out", "fit out", "facility upgrade", "facility modernization", "room build",
        "secure room build", "scif build-out", "scif build out", "shielding installation", "rf shielding installation", "commissioning", "testing adjusting and balancing",
        "hvac upgrade", "mechanical upgrade", "electrical upgrade", "uninterruptible power supply", "backup generator", "raised floor", "pre-action sprinkler",
        "clean agent suppression", "novec 1230", "fm-200",
    ],
    "aerospace": [
        "hypersonic", "scramjet", "ramjet", "rocket-based combined cycle", "low observable", "radar cross section", "signature management", "stealth", "sigint", "elint", "comint",
        "jamming", "jammer", "electronic warfare", "electronic attack", "electronic protection", "electronic support", "directed energy", "high power microwave", "counter-uas",
        "counter unmanned aircraft",
    ],
}
