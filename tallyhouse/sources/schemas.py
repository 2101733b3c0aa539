"""Canonical column names of the report inputs, by header (spaces removed)."""

# Header → canonical name. Fixed values.
CLIENTS = {
    "ClientId": "client_id",
    "DateofBirth": "birth_date",
    "Gender": "gender",
    "CensusRace": "census_race",
    "Ethnicity": "ethnicity",
    "ClientStatus": "client_status",
    "NewlyHomeless": "newly_homeless",
    "StatusDate": "status_date",
    "Veteran?": "veteran",
}
CLIENTS_BLANK_HEADER = (9, "NewlyHomeless")

MEMBERSHIPS = {
    "ClientUid": "client_id",
    "HouseholdId": "household_id",
    "HouseholdRelationship": "relationship",
}

ENTRIES = {
    "EntryExitClientId": "client_id",
    "EntryExitGroupUID": "group_uid",
    "VARCreatedHouseholdID": "household_key",
    "EntryExitProviderId": "provider_id",
    "EntryExitProviderProgramTypeCode": "program_type",
    "EntryExitEntryDate": "entry_ts",
    "EntryExitExitDate": "exit_date",
    "ExitDestinationType": "exit_destination",
    "ClientAgeatEntry": "age_at_entry",
}

DEMOGRAPHICS = {
    "ClientUid": "client_id",
    "MostRecentAssessmentScore": "score",
    "VeteranStatus": "veteran_status",
    "PrimaryRace": "primary_race",
    "SecondaryRace": "secondary_race",
    "Ethnicity": "ethnicity",
}

PROVIDERS = {"Agency": "agency", "Provider": "provider_id"}

CALLS = {
    "NeedHouseholdId": "household_id",
    "ClientUid": "client_id",
    "NeedDateAdded": "need_date",
    "NeedCodeDescription": "need_code",
    "ClientVeteranStatus": "veteran_status",
    "NameString": "name_string",
    "Age": "supplied_age",
}

SITUATIONS = {
    "ClientUid": "client_id",
    "EventDate": "event_date",
    "PriorLivingSituation": "prior_situation",
    "FleeingDV": "fleeing_dv",
}

CALLER_DEMOGRAPHICS = {
    "ClientUid": "client_id",
    "DateofBirth": "birth_date",
    "PrimaryRace": "primary_race",
    "SecondaryRace": "secondary_race",
    "Ethnicity": "ethnicity",
}

CALLPOINT = {
    "ClientID": "client_id",
    "CallRecordStartDate": "call_date",
    "CallRecordCallType": "call_type",
    "VeteranStatus": "veteran_status",
    "NameString": "name_string",
    "DateofBirth": "birth_date",
    "PriorLivingSituation": "prior_situation",
    "PrimaryRace": "primary_race",
    "SecondaryRace": "secondary_race",
    "Ethnicity": "ethnicity",
    "FleeingDV": "fleeing_dv",
}

# Known test record in the call extracts.
TEST_CLIENTS = (26860,)
