"""Words of file names and metadata that place a document whose text cannot be read."""

from __future__ import annotations

# Words of each class by language, in the order they are looked for.
PAYROLL: dict[str, list[str]] = {
    "en": ["payslip", "payroll", "salary", "compensation", "wage", "earnings"],
    "sv": ["lönespecifikation", "lönspec", "lön", "månadslön", "bruttolön", "nettolön", "lonespecifikation", "lonspec", "lon", "manadslon", "bruttolon", "nettolon"],
    "da": ["lønseddel", "løn", "månedsløn", "bruttoløn", "nettoløn", "lonseddel", "maanedslon", "bruttolon", "nettolon"],
    "no": ["lønnslipp", "lønn", "månedslønn", "bruttolønn", "nettolønn", "lonnslipp", "lonn", "maanedslonn", "bruttolonn", "nettolonn"],
    "fi": ["palkkalaskelma", "palkka", "kuukausipalkka"],
    "de": ["gehaltsabrechnung", "lohnabrechnung", "gehalt", "lohn", "entgelt"],
    "fr": ["bulletin", "salaire", "paie", "fiche de paie"],
    "es": ["nómina", "nomina", "salario", "sueldo", "recibo de nómina", "recibo de nomina", "liquidación", "liquidacion", "remuneración", "remuneracion", "bruto", "neto", "salario bruto", "salario neto", "sueldo bruto", "sueldo neto"],
    "it": ["busta paga", "cedolino", "stipendio", "retribuzione"],
    "nl": ["loonstrook", "salaris", "loon"],
    "pt": ["recibo de vencimento", "salário", "contracheque", "salario"],
    "pl": ["pasek wynagrodzeń", "wynagrodzenie", "pensja", "pasek wynagrodzen"],
}
HR: dict[str, list[str]] = {
    "en": ["employment", "contract", "agreement", "employee", "personnel", "termination", "resignation"],
    "sv": ["anställningsavtal", "anställning", "arbetsavtal", "personal", "uppsägning"],
    "da": ["ansættelseskontrakt", "ansættelse", "arbejdsaftale", "medarbejder", "opsigelse"],
    "no": ["arbeidsavtale", "ansettelse", "arbeidstaker", "oppsigelse"],
    "fi": ["työsopimus", "työntekijä", "henkilöstö", "irtisanominen"],
    "de": ["arbeitsvertrag", "anstellungsvertrag", "mitarbeiter", "kündigung", "arbeitnehmer"],
    "fr": ["contrat de travail", "employé", "salarié", "licenciement", "démission"],
    "es": ["contrato de trabajo", "empleador", "empleado", "trabajador", "despido", "renuncia", "relación laboral", "relacion laboral", "cláusulas", "clausulas", "fecha de inicio", "duración", "duracion", "puesto de trabajo", "jornada laboral"],
    "it": ["contratto di lavoro", "dipendente", "lavoratore", "licenziamento", "dimissioni"],
    "nl": ["arbeidsovereenkomst", "werknemer", "medewerker", "ontslag"],
    "pt": ["contrato de trabalho", "empregado", "funcionário", "demissão"],
    "pl": ["umowa o pracę", "pracownik", "zatrudnienie", "zwolnienie"],
}
INSURANCE: dict[str, list[str]] = {
    "en": ["insurance", "policy", "policyholder", "premium", "coverage", "claim"],
    "sv": ["försäkring", "försäkringsbrev", "premie", "försäkringstagare"],
    "da": ["forsikring", "forsikringspolice", "præmie", "forsikringstager"],
    "no": ["forsikring", "forsikringspolise", "premie", "forsikringstaker"],
    "fi": ["vakuutus", "vakuutuskirja", "vakuutusmaksu"],
    "de": ["versicherung", "versicherungspolice", "prämie", "versicherungsnehmer"],
    "fr": ["assurance", "police", "prime", "assuré"],
    "es": ["seguro", "póliza", "poliza", "prima", "asegurado", "aseguradora", "cobertura", "siniestro", "condiciones generales", "seguro de vida", "seguro de auto", "seguro de hogar", "seguro de salud"],
    "it": ["assicurazione", "polizza", "premio", "assicurato"],
    "nl": ["verzekering", "polis", "premie", "verzekerde"],
    "pt": ["seguro", "apólice", "prêmio", "segurado"],
    "pl": ["ubezpieczenie", "polisa", "składka", "ubezpieczony"],
}
