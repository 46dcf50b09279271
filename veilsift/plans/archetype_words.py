"""Marks that tell archetypes of documents, as ECMAScript expressions."""

from __future__ import annotations

# Of each archetype, its strong marks, then its other ones, in the order they are looked for.
MARKERS: dict[str, tuple[list[str], list[str]]] = {
    "resume_cv": (
        [
            r"\bcurriculum\s*vitae\b",
            r"\bresume\b",
            r"\b(?:cv|c\.v\.)\b",
            r"\blebenslauf\b",
            r"(?<!\p{L})meritförteckning(?!\p{L})",
            r"(?<!\p{L})currículo(?!\p{L})",
            r"\bhoja\s+de\s+vida\b",
        ],
        [
            r"\bwork\s+experience\b",
            r"\beducation\b",
            r"\bskills?\b",
            r"\bprofessional\s+(?:summary|profile)\b",
            r"\bemployment\s+history\b",
            r"\bberufserfahrung\b",
            r"\bausbildung\b",
            r"\barbejdserfaring\b",
            r"\buddannelse\b",
            r"(?<!\p{L})experiência\s+profissional(?!\p{L})",
            r"(?<!\p{L})formação(?!\p{L})",
            r"(?<!\p{L})habilidades(?!\p{L})",
            r"(?<!\p{L})competências(?!\p{L})",
            r"\bexperiencia\s+laboral\b",
            r"(?<!\p{L})formación(?!\p{L})",
            r"(?<!\p{L})expérience\s+professionnelle(?!\p{L})",
        ],
    ),
    "ticket_booking": (
        [
            r"\bboarding\s*pass\b",
            r"\be-?ticket\b",
            r"\bbooking\s*(?:ref|reference|confirmation)\b",
            r"\btarjeta\s+de\s+embarque\b",
            r"\bflugschein\b",
        ],
        [
            r"\bflight\s*(?:number|no\.?|#)\b",
            r"\bgate\s*[:#]?\s*[A-Z]?\d+\b",
            r"\bseat\s*[:#]?\s*\d+[A-Z]?\b",
            r"\bpassenger\b",
            r"\bdeparture\b",
            r"\barrival\b",
            r"\breservation\b",
            r"\bbillet\b",
            r"\bbiljett\b",
        ],
    ),
    "invoice_receipt": (
        [
            r"\binvoice\s*(?:number|no\.?|#)\b",
            r"\breceipt\s*(?:number|no\.?|#)\b",
            r"\bfaktura(?:nummer)?\b",
            r"\brechnung(?:snummer)?\b",
            r"\bfactura\b",
        ],
        [
            r"\btotal\s*(?:amount|due)\b",
            r"\bsubtotal\b",
            r"\bvat\b",
            r"\bmoms\b",
            r"\bpayment\s*(?:due|terms)\b",
            r"\bdue\s*date\b",
            r"\bitem\s*description\b",
            r"(?<!\p{L})beløb(?!\p{L})",
        ],
    ),
    "medical_record": (
        [
            r"\bpatient\s*(?:record|journal|id)\b",
            r"\bmedical\s*record\b",
            r"\blab\s*result\b",
            r"\bpatientjournal\b",
            r"\blaboratoriesvar\b",
            r"\bepikrise\b",
        ],
        [
            r"\bdiagnosis\b",
            r"\bprescription\b",
            r"\bmedication\b",
            r"\btreatment\b",
            r"\bprognosis\b",
            r"(?<!\p{L})blodprøve(?!\p{L})",
            r"(?<!\p{L})undersøgelse(?!\p{L})",
        ],
    ),
    "legal_authority": (
        [
            r"\bpower\s+of\s+attorney\b",
            r"\blegal\s+notice\b",
            r"\bnotarized\b",
            r"\bfuldmagt\b",
            r"\bvollmacht\b",
            r"\bpoder\s+notarial\b",
        ],
        [
            r"\bhereby\s+(?:authorize|grant|certify)\b",
            r"\bwitness(?:ed)?\s+(?:by|signature)\b",
            r"\bauthorized\s+(?:representative|signatory)\b",
            r"\blegally\s+binding\b",
            r"\baffidavit\b",
            r"\bdeclaration\b",
            r"\bunderskrift\b",
        ],
    ),
    "employment_hr": (
        [
            r"\bemployee\s+(?:record|file|handbook)\b",
            r"\bhr\s+(?:record|file|document)\b",
            r"\bperformance\s+(?:review|evaluation|appraisal)\b",
            r"\bsalary\s+(?:slip|statement|details)\b",
            r"(?<!\p{L})lønbesked(?!\p{L})",
            r"\bgehaltsabrechnung\b",
        ],
        [
            r"\bcompensation\b",
            r"\bbonus\b",
            r"\btermination\b",
            r"\bprobation(?:ary)?\b",
            r"\bemployment\s+contract\b",
            r"(?<!\p{L})ansættelseskontrakt(?!\p{L})",
            r"\barbeitsvertrag\b",
        ],
    ),
    "insurance": (
        [
            r"\binsurance\s+(?:policy|certificate|claim)\b",
            r"\bpolicy\s+(?:number|holder)\b",
            r"\bforsikringspolice\b",
            r"\bversicherungspolice\b",
            r"(?<!\p{L})póliza\s+de\s+seguro(?!\p{L})",
        ],
        [
            r"\bpremium\b",
            r"\bcoverage\b",
            r"\bdeductible\b",
            r"\bclaim\b",
            r"\bbeneficiary\b",
            r"\bselvrisiko\b",
        ],
    ),
    "education_school": (
        [
            r"\bstudent\s+(?:record|file|transcript)\b",
            r"\bacademic\s+(?:record|transcript)\b",
            r"\breport\s+card\b",
            r"\bschool\s+(?:record|report)\b",
            r"\belevjournal\b",
            r"\bzeugnis\b",
        ],
        [
            r"\benrollment\b",
            r"\bgrade\s*(?:s|point)\b",
            r"\battendance\b",
            r"\bparent(?:s)?(?:'s)?\s+(?:consent|signature)\b",
            r"\bguardian\b",
            r"(?<!\p{L})skoleudtalelse(?!\p{L})",
        ],
    ),
    "template_governance": (
        [
            r"\brecord\s+of\s+processing\s+activit(?:y|ies)\b",
            r"\bropa\b",
            r"\bdata\s+processing\s+(?:agreement|inventory|register)\b",
            r"\bprivacy\s+(?:impact\s+assessment|policy|notice)\b",
            r"\bdata\s+protection\s+(?:impact\s+assessment|officer|policy)\b",
            r"\bsecurity\s+questionnaire\b",
            r"\bvendor\s+(?:assessment|questionnaire|evaluation)\b",
            r"\bcompliance\s+(?:questionnaire|checklist|template)\b",
            r"\bperformance\s+evaluation\s+(?:overview|form|template)\b",
            r"\btalent\s+development\s+(?:information|plan|template)\b",
        ],
        [
            r"\bdata\s+controller\b",
            r"\bdata\s+processor\b",
            r"\bdata\s+subject\b",
            r"\bprocessing\s+activit(?:y|ies)\b",
            r"\blegal\s+basis\b",
            r"\bretention\s+period\b",
            r"\bgdpr\b",
            r"\barticle\s+(?:6|9|13|14|15|30)\b",
            r"\bpurpose\s+of\s+processing\b",
            r"\bcategories\s+of\s+(?:data|recipients)\b",
            r"\bmanager'?s?\s+signature\b",
            r"\b(?:below|meet|exceed)\s+expectations\b",
            r"\bgoal\s+setting\b",
        ],
    ),
    "policy_standard": (
        [
            r"\b(?:information\s+)?security\s+polic(?:y|ies)\b",
            r"\bdata\s+(?:classification|handling)\s+(?:polic(?:y|ies)|standards?|procedures?)\b",
            r"\bacceptable\s+use\s+polic(?:y|ies)\b",
            r"\bstandard\s+operating\s+procedures?\b",
            r"\b(?:policy|procedure)\s+(?:number|no|ref|id)\s*[:.]?\s*\w",
            r"\bdocument\s+(?:owner|approver|reviewer)\b",
            r"\beffective\s+date\b.*\b(?:review|expir|revis)",
            r"\bversion\s+(?:history|control)\b",
            r"\bcompliance\s+(?:polic(?:y|ies)|standards?|frameworks?|requirements?)\b",
            r"\b(?:iso|nist|soc)\s*[\s-]*\d",
        ],
        [
            r"\bcontrol(?:s)?\b",
            r"\b(?:safeguards?|countermeasures?|mitigations?)\b",
            r"\brisk\s+(?:assessments?|analy(?:sis|ses)|registers?|treatments?)\b",
            r"\bauthori[sz]ed\b",
            r"\bunauthori[sz]ed\b",
            r"\b(?:shall|must)\s+(?:not\s+)?(?:be|comply|ensure|maintain|report)\b",
            r"\bsection\s+\d+(?:\.\d+)*\b",
            r"\bscope\s+(?:of\s+)?(?:this|the)\s+(?:polic(?:y|ies)|standards?|procedures?|documents?)\b",
        ],
    ),
    "clinical_reference": (
        [
            r"\bclinical\s+(?:guidelines?|pathways?|practice\s+guidelines?)\b",
            r"\bformular(?:y|ies)\b",
            r"\btherapeutic\s+(?:class(?:es)?|categor(?:y|ies)|areas?|groups?)\b",
            r"\bevidence[\s-]+based\s+(?:medicine|practices?|recommendations?|guidelines?)\b",
            r"\brecommendations?\s+(?:grades?|strengths?|levels?)\b",
            r"\bpharmacokinetics?\b",
            r"\bpharmacology\b",
        ],
        [
            r"\bsystematic\s+reviews?\b",
            r"\bmeta[\s-]*analy(?:sis|ses)\b",
            r"\bclinical\s+trials?\b",
            r"\bdosages?\b",
            r"\badministration\s+(?:routes?|forms?|methods?)\b",
            r"\bdrug\s+interactions?\b",
            r"\b(?:etiology|pathogenesis|epidemiology)\b",
            r"\bcontraindications?\b",
        ],
    ),
    "aggregate_hr_finance": (
        [
            r"\bheadcount\b",
            r"\b(?:total|aggregate)\s+(?:employees?|staff|fte|headcount)\b",
            r"\bdepartment\s+(?:summary|overview|breakdown|report)\b",
            r"\bbudget\s+(?:summary|overview|allocation|forecast)\b",
            r"\b(?:annual|quarterly|monthly)\s+(?:report|review|summary)\b",
            r"\bworkforce\s+(?:planning|analytics?|metrics?|dashboard)\b",
            r"\b(?:turnover|attrition|retention)\s+rate\b",
            r"\borgani[sz]ational?\s+(?:chart|structure|overview)\b",
        ],
        [
            r"\bkpi\b",
            r"\b(?:total|average|median)\s+(?:salary|compensation|cost)\b",
            r"\byear[\s-]+over[\s-]+year\b",
            r"\bfiscal\s+year\b",
            r"\b(?:cost\s+per\s+hire|recruitment\s+cost)\b",
            r"\boperating\s+(?:expenses?|budget|costs?)\b",
            r"\bforecast\b",
            r"\bboard\s+(?:report|presentation|deck|summary)\b",
        ],
    ),
}
# Marks of contracts; two of them rule out a policy.
CONTRACT = [
    r"\bwhereas\b",
    r"\bhereby\b",
    r"\bindemnif(?:y|ies|ication)\b",
    r"\bgoverning\s+law\b",
    r"\bparty\s+[ab]\b",
    r"\b(?:first|second)\s+party\b",
    r"\b(?:executed|signed|witnessed)\s+(?:by|on|this)\b",
    r"\bnon[\s-]*disclosure\s+agreement\b",
]
