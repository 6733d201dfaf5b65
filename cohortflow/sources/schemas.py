"""Schemas of the clinical source tables."""

SCHEMAS = {
    "icustays": "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz",
    "chartevents": "subject_id long, stay_id long, charttime timestamp_ntz, itemid int, valuenum double, value string",
    "labevents": "subject_id long, hadm_id long, charttime timestamp_ntz, itemid int, valuenum double",
    "outputevents": "subject_id long, stay_id long, charttime timestamp_ntz, value double",
    "inputevents": "stay_id long, itemid int, starttime timestamp_ntz, endtime timestamp_ntz, rate double, "
    "rateuom string, amount double",
    "procedureevents": "stay_id long, itemid int, starttime timestamp_ntz, endtime timestamp_ntz, value double",
    "services": "hadm_id long, curr_service string, transfertime timestamp_ntz",
    "diagnoses_icd": "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
    "admission_type string, language string, insurance string, race string",
    "patients": "subject_id long, gender string, anchor_age int, anchor_year int, dod date",
}
