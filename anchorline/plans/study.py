"""The care-home study end to end: every derived table from the source extracts.

Give it the source tables (contracts in :mod:`anchorline.schema`) and the code
lists; every attribute is one derived table.  With a ``store`` folder each table
is written once and read back, so later plans start from files rather than
repeating the lineage above them.  Source tables, by key:

``spells person observation deaths``     social care, demographics, registry
``coded``         person_id, event_time, ctv3code, snomedcode, text, value (text)
``medications drug_lookup``              primary-care drugs and their chapter codes
``inpatient_a ed_a inpatient_b ed_b
inpatient_c``                   episodes of three hospital sites (C up to diagnosis_6)
``inpatient_b_early``             earlier episodes of site B, kept in a table of their own
``ed_b_groups``                   ED visits with a '^'-delimited code group
``person_area area_index``               small areas and deprivation deciles
``ethnicity_text ethnicity_group``       person_id, text / person_id, group

Code lists, by key: ``hypertension chd`` (SNOMED), ``ckd diabetes smoker_ex
smoker_current smoker_non bp mi_ctv3`` (CTV3), ``heart_failure mi syncope``
(ICD-10), ``falls_snomed``; ``falls`` and ``stroke`` default to the fixed lists.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.dates import after, around, before, month_range
from anchorline.functions.text import up_to_delimiter
from anchorline.functions.values import recode, safe_cast
from anchorline.operators.codes import code_in, label_by_values, label_codes
from anchorline.operators.joins import assemble_master, restrict_to, stack_sources
from anchorline.operators.select import sample_one_per
from anchorline.operators.tabulate import prevalence, quantiles, summary_table
from anchorline.plans import cohort as c, constants as k, exposure as x, measure as m
from anchorline.plans import outcome as o, phenotype as p, rates as r, stats as st
from anchorline.plans import survival as sv
from anchorline.schema import INDEX, PERSON, TIME
from anchorline.sources.codelists import code_frame
from anchorline.sources.tables import load, publish

THREE = ["diagnosis_1", "diagnosis_2", "diagnosis_3"]
FOUR = THREE + ["diagnosis_4"]
SIX = FOUR + ["diagnosis_5", "diagnosis_6"]


class CareHomeStudy:
    def __init__(self, tables: Mapping[str, DataFrame], codes: Mapping[str, object],
                 store: str | None = None):
        self.t, self.store = dict(tables), store
        self.codes = {"falls": k.FALL_CODES,
                      "stroke": k.STROKE_CODES, **codes}
        self.spark = next(iter(self.t.values())).sparkSession

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        if self.store is None:
            return df
        publish(df, name, self.store)
        return load(self.spark, name, self.store)

    # --- cohort ---------------------------------------------------------------

    @cached_property
    def cohort_base(self) -> DataFrame:
        """Everyone who passes the exclusions, with follow-up."""
        built = c.build_cohort(self.t["spells"], self.t["person"], self.t["observation"],
                               k.SERVICE_TYPES, k.INDEX_BEFORE)
        dated = c.reconcile_death(built, self.t["deaths"])
        kept, _ = c.apply_exclusions(dated, self.rules)
        return self._keep("cohort_base", c.follow_up(kept))

    @property
    def rules(self) -> list[tuple[str, Column]]:
        return c.entry_rules(k.EXCLUDED_INDEX_DATES, k.MIN_AGE, k.MIN_STAY_DAYS)

    @cached_property
    def attrition(self) -> DataFrame:
        built = c.build_cohort(self.t["spells"], self.t["person"], self.t["observation"],
                               k.SERVICE_TYPES, k.INDEX_BEFORE)
        dated = c.reconcile_death(built, self.t["deaths"])
        return c.apply_exclusions(dated, self.rules)[1]

    @cached_property
    def cohort(self) -> DataFrame:
        """Persons with hypertension whose follow-up does not end before it starts.

        Two stages: hypertension is decided on ``cohort_base``, which breaks the
        circle between the cohort and the diagnosis.
        """
        diagnosed = self.hypertension.where("hypertension")
        return self._keep("cohort", c.drop_ended_before_index(
            restrict_to(self.cohort_base, diagnosed)))

    @cached_property
    def ghost_death_date(self) -> DataFrame:
        return c.presumed_exit(self.cohort, self.t["observation"])

    @cached_property
    def deprivation(self) -> DataFrame:
        return c.attach_area_index(self.cohort, self.t["person_area"], self.t["area_index"])

    @cached_property
    def ethnicity(self) -> DataFrame:
        texts = restrict_to(self.t["ethnicity_text"], self.cohort)
        known = texts.where(~F.col("text").isin(k.ETHNICITY_UNKNOWN))
        return c.resolve_category(self.cohort.select(PERSON, "gender", "age_at_index"),
                                  self.t["ethnicity_group"],
                                  sample_one_per(known, PERSON, "text", seed=1),
                                  k.ETHNICITY_RECODE)

    # --- conditions -----------------------------------------------------------

    @cached_property
    def readings(self) -> DataFrame:
        """Blood-pressure readings by kind from SNOMED codes; other codes fall out."""
        kind = label_by_values(F.col("snomedcode"), k.READING_CODES)
        value = safe_cast(F.col("value"), "decimal(38,9)")
        return (self.t["coded"].select(PERSON, TIME, kind.alias("kind"), value.alias("value"))
                .where(F.col("kind").isNotNull()))

    @cached_property
    def hypertension(self) -> DataFrame:
        """By code ever before admission, or by two high readings in two years."""
        coded = p.diagnosis_before(self.cohort_base, self.t["coded"], self.codes["hypertension"],
                                   code="snomedcode").where("diagnosed")
        measured = p.two_reading_rule(self.readings, self.cohort_base, k.READING_THRESHOLDS,
                                      floor=k.READING_FLOOR).where("meets_rule")
        return self._keep("hypertension_combined", p.combine_flags(
            self.cohort_base.select(PERSON, INDEX), coded, measured, flag_as="hypertension"))

    def _diagnosis(self, name: str, code: str, code_list: str) -> DataFrame:
        return p.diagnosis_before(self.cohort, self.t["coded"], self.codes[code_list], code,
                                  flag_as=f"{name}_diagnosis", date_as=f"{name}_diagnosis_date")

    @cached_property
    def chd(self) -> DataFrame:
        return self._diagnosis("chd", "snomedcode", "chd")

    @cached_property
    def ckd(self) -> DataFrame:
        return self._diagnosis("ckd", "ctv3code", "ckd")

    @cached_property
    def diabetes(self) -> DataFrame:
        return self._diagnosis("dm", "ctv3code", "diabetes")

    @cached_property
    def previous_stroke(self) -> DataFrame:
        """Discharged with stroke in the 12 months before admission, either site.

        One row per person; site A reports the discharge, site C the start.
        """
        sites = stack_sources(
            self.t["inpatient_a"].select(PERSON, "end_time", F.col("end_time").alias("at"), *THREE),
            self.t["inpatient_c"].where("episode_sequence = 1").select(
                PERSON, "end_time", F.col(TIME).alias("at"), *SIX))
        return p.event_within(self.cohort, sites, SIX, before(365), codes=self.codes["stroke"],
                              flag_as="previous_stroke", time="end_time", report="at")

    @cached_property
    def smoking(self) -> DataFrame:
        lists = {"ex-smoker": self.codes["smoker_ex"], "current smoker": self.codes["smoker_current"],
                 "non-smoker": self.codes["smoker_non"]}
        labels = label_codes({label: codes if isinstance(codes, DataFrame)
                              else code_frame(self.spark, codes) for label, codes in lists.items()})
        events = self.t["coded"].select(PERSON, TIME, F.col("ctv3code").alias("code"), "text")
        return p.latest_category(self.cohort, events, labels, status_as="smoking_status")

    # --- drugs ----------------------------------------------------------------

    @cached_property
    def drug_exposure(self) -> DataFrame:
        """The three time points in one pass; each with its own admitted codes."""
        every = sorted(set(k.DRUG_PREFIXES) | set(k.DRUG_PREFIXES_AT_ADMISSION))
        drugs = x.classify_drugs(self.t["medications"], self.t["drug_lookup"], every)
        windows = dict(zip(k.TIME_POINTS, (month_range(-6, -5), around(14), month_range(5, 6))))
        admitted = dict(zip(k.TIME_POINTS, (k.DRUG_PREFIXES, k.DRUG_PREFIXES_AT_ADMISSION,
                                            k.DRUG_PREFIXES)))
        return self._keep("antihypertensives", x.drug_exposure(
            drugs, self.cohort, windows, k.DRUG_CLASSES, admitted=admitted))

    def drugs_at(self, time_status: str) -> DataFrame:
        return self.drug_exposure.where(F.col("time_status") == time_status).drop("time_status")

    @cached_property
    def drugs_long(self) -> DataFrame:
        return self._keep("antihypertensive_long", x.exposure_long(
            self.cohort, self.drug_exposure, k.TIME_POINTS, list(k.DRUG_CLASSES)))

    @cached_property
    def drugs_kept(self) -> DataFrame:
        """Long form without the after-admission rows of early deaths."""
        late = (F.col("time_status") == "post_admission") & F.col("early_death")
        return self.drugs_long.where(~late)

    def drug_counts(self, cap: int = 4, excluding: Sequence[str] = ()) -> DataFrame:
        counts = x.class_counts(self.drugs_kept, excluding, list(k.DRUG_CLASSES))
        return x.count_distribution(counts, cap)

    def share_prescribed(self) -> DataFrame:
        """Share of persons on each class at each time point."""
        return x.share_prescribed(self.drugs_kept, list(k.DRUG_CLASSES))

    def risk_factors(self) -> DataFrame:
        """Body mass index and the share with each cardiovascular risk factor, by hypertension.

        Needs ``bmi`` (person_id, bmi); conditions beyond those the study derives come as further
        columns of a ``conditions`` source (one row per person).
        """
        tables = [self.t["bmi"], *([self.t["conditions"]] if "conditions" in self.t else [])]
        people = assemble_master(self.master, tables)
        extra = [c for c in self.t["conditions"].columns if c != PERSON] if "conditions" in self.t else []
        return summary_table(people, ["bmi"], ["ckd_diagnosis", "chd_diagnosis", "dm_diagnosis", "previous_stroke",
                                               "smoking_status", *extra], "hypertension", na_include=True, na_to_p=False)

    def months_to_death(self) -> DataFrame:
        """Quartiles of the time to death in months, of those who died."""
        died = self.cohort.where(F.col("dod").isNotNull())
        return quantiles(died.withColumn("months", F.col("fu_days") / k.DAYS_PER_MONTH), "months", [0.25, 0.5, 0.75])

    def prescribing_change(self, flag: str) -> DataFrame:
        """McNemar, six months before against admission, paired by person."""
        at = F.col("time_status")
        paired = self.drugs_kept.groupBy(PERSON).agg(
            F.max(F.when(at == "pre_admission", F.col(flag))).alias("before"),
            F.max(F.when(at == "admission", F.col(flag))).alias("after"))
        return st.mcnemar(paired, F.col("before"), F.col("after"))

    # --- blood pressure -------------------------------------------------------

    def _pressure(self, bounds, ranges) -> DataFrame:
        text = F.col("text")
        kind = F.when(text.contains("iastolic"), "diastolic").when(text.contains("ystolic"), "systolic")
        coded = code_in(self.t["coded"], "ctv3code", self.codes["bp"])
        events = coded.select(PERSON, TIME, kind.alias("kind"),
                              safe_cast(F.col("value"), "decimal(38,9)").alias("value"))
        return m.paired_reading(events, self.cohort, bounds, ranges, floor=k.READING_FLOOR)

    @cached_property
    def bp_pre(self) -> DataFrame:
        return self._keep("bp_pre_admission", self._pressure(before(365), k.PRE_RANGES))

    @cached_property
    def bp_post(self) -> DataFrame:
        return self._keep("bp_post_admission", self._pressure(after(365), k.POST_RANGES))

    @cached_property
    def bp_difference(self) -> DataFrame:
        return m.before_after(self.bp_pre, self.bp_post)

    # --- outcomes -------------------------------------------------------------

    @cached_property
    def cv_deaths(self) -> DataFrame:
        code = F.col("cause_code_1")
        cause = (code.startswith(k.CV_CODE_PREFIX) | code.contains(k.CV_TEXT_1)
                 | F.col("cause_code_4").contains(k.CV_TEXT_4))
        return o.cause_death(self.t["deaths"], self.cohort, cause)

    def _first(self, table: str, **options) -> DataFrame:
        return o.first_event_after(self.t[table], self.cohort, options.pop("columns", THREE), **options)

    @cached_property
    def mi_events(self) -> DataFrame:
        """Both sites' first admissions and every primary-care code."""
        sites = [self._first(table, prefixes=k.MI_PREFIXES, first_in_spell=False)
                 for table in ("inpatient_a", "inpatient_b")]
        primary = o.events_after(self.t["coded"], self.cohort, self.codes["mi_ctv3"], "ctv3code")
        return stack_sources(*[e.select(PERSON, TIME) for e in (*sites, primary)])

    @cached_property
    def stroke_events(self) -> DataFrame:
        """First stroke discharge after admission per site; one row per person."""
        sites = stack_sources(
            self.t["inpatient_a"].select(PERSON, "end_time", F.col("end_time").alias("at"), *THREE),
            self.t["inpatient_c"].where("episode_sequence = 1").select(
                PERSON, "end_time", F.col(TIME).alias("at"), *SIX))
        found = p.event_within(self.cohort, sites, SIX, after(365), codes=self.codes["stroke"],
                               time="end_time", report="at").where("had_event")
        return found.select(PERSON, F.col("first_event").alias(TIME))

    @cached_property
    def mace(self) -> DataFrame:
        """Cardiovascular death, myocardial infarction and stroke as typed events."""
        return self._keep("mace", o.composite_outcome(
            o.typed(self.cv_deaths, "cv death"), o.typed(self.mi_events, "myocardial infarction"),
            o.typed(self.stroke_events, "stroke")))

    @cached_property
    def mace_extended(self) -> DataFrame:
        """MACE with the earlier episodes of site B, cut to three characters."""
        early, people = self.t["inpatient_b_early"], self.cohort
        mi = o.episodes_after(early, people, FOUR, codes=k.MI_THREE_CHAR, prefix_len=3)
        stroke = o.episodes_after(early, people, FOUR, codes=self.codes["stroke"], prefix_len=3)
        return o.composite_outcome(o.typed(mi, "myocardial infarction"),
                                   o.typed(stroke, "stroke"), self.mace)

    @cached_property
    def mace_distinct(self) -> DataFrame:
        """Fatal and repeated episodes reduced to one event, index day excluded."""
        later = self.mace_extended.join(self.cohort.select(PERSON, INDEX), PERSON).where(
            F.to_date(TIME) > F.col(INDEX)).drop(INDEX)
        return o.drop_followed_events(later, {"myocardial infarction", "stroke"},
                                      k.EPISODE_GAP_DAYS)

    def _admissions(self, code_list: str) -> DataFrame:
        firsts = [self._first(table, codes=self.codes[code_list], first_in_spell=False)
                  for table in ("ed_a", "inpatient_b")]
        return stack_sources(*[f.select(PERSON, INDEX, TIME) for f in firsts])

    @cached_property
    def heart_failure(self) -> DataFrame:
        return self._admissions("heart_failure")

    @cached_property
    def myocardial_infarction(self) -> DataFrame:
        return self._admissions("mi")

    def _three_site(self, inpatient: Sequence[DataFrame], ed: Sequence[DataFrame],
                    find: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        return o.first_across_sources(*[find(e, True) for e in inpatient],
                                      *[find(e, False) for e in ed])

    @cached_property
    def injurious_falls(self) -> DataFrame:
        """First fall or fragility fracture after admission, ED and inpatient.

        ED codes are also tested, untruncated, against the SNOMED list.
        """
        def find(rows: DataFrame, inpatient: bool) -> DataFrame:
            icd = o.first_event_after(rows, self.cohort, THREE, codes=self.codes["falls"],
                                      prefix_len=3, first_in_spell=inpatient)
            if inpatient or "falls_snomed" not in self.codes:
                return icd
            snomed = o.first_event_after(rows, self.cohort, THREE, codes=self.codes["falls_snomed"],
                                         first_in_spell=False)
            return o.first_across_sources(icd, snomed)

        return self._keep("injurious_falls", self._three_site(
            [self.t["inpatient_a"], self.t["inpatient_b"]],
            [self.t["ed_a"], self.t["ed_b"]], find))

    @cached_property
    def site_b_groups(self) -> DataFrame:
        """ED visits whose codes come as one '^'-delimited text: the first code counts."""
        return self.t["ed_b_groups"].select(
            PERSON, TIME, "end_time", up_to_delimiter(F.col("diag_group"), "^").alias("diagnosis_1"),
            F.lit(None).cast("string").alias("diagnosis_2"),
            F.lit(None).cast("string").alias("diagnosis_3"))

    @cached_property
    def syncope(self) -> DataFrame:
        def find(rows: DataFrame, inpatient: bool) -> DataFrame:
            return o.first_event_after(rows, self.cohort, THREE, codes=self.codes["syncope"],
                                       prefix_len=3, first_in_spell=inpatient)

        third = self.t["inpatient_c"].withColumn("episode_sequence", F.lit(1))
        return self._keep("syncope", self._three_site(
            [self.t["inpatient_a"], self.t["inpatient_b"],
             self.t["inpatient_b_early"], third],
            [self.t["ed_a"], self.site_b_groups], find))

    @cached_property
    def falls_or_syncope(self) -> DataFrame:
        """Person's first of the two, the index day excluded."""
        return o.first_of(o.composite_outcome(o.typed(self.injurious_falls, "falls"),
                                              o.typed(self.syncope, "syncope")), self.cohort)

    # --- analyses -------------------------------------------------------------

    def incidence(self, events: DataFrame, first_only: bool = True,
                  cut: str | None = None) -> DataFrame:
        """Events per 100 person-years with exact limits, overall or by period."""
        exposed = r.exposure_days(self.cohort, events, k.EXPOSURE_DAYS, first_only)
        by = []
        if cut is not None:
            exposed, by = exposed.withColumn("period", c.stratify_by_date(F.col(INDEX), cut)), ["period"]
        return st.poisson_rate_ci(r.incidence_rate(exposed, by), per=100)

    def incidence_change(self, events: DataFrame, cut: str = k.COVID_CUT) -> DataFrame:
        """Exact comparison of the rates before and after a date."""
        return st.poisson_compare(self.incidence(events, cut=cut), "period", ("before", "after"))

    @cached_property
    def mace_events(self) -> DataFrame:
        return self.mace_distinct.select(PERSON, F.col("event_date").cast("timestamp_ntz").alias(TIME))

    @cached_property
    def survival_input(self) -> DataFrame:
        """Days to death or censoring; the lost are censored at their last date."""
        return self.cohort.withColumns({
            "survival_days": F.coalesce("mortality_days", "fu_days"),
            "died": F.col("end_of_fu_status") == "died",
            "year_of_admission": F.year(INDEX).cast("string")})

    def survival_curve(self, by: Sequence[str] = (), unit_days: float = 365 / 12) -> DataFrame:
        """Product-limit curve with time in months."""
        curve = sv.kaplan_meier(self.survival_input, "survival_days", "died", by)
        return curve.withColumn("time", F.col("time") / F.lit(unit_days))

    def survival_at(self, by: Sequence[str] = ()) -> DataFrame:
        return sv.km_at(self.survival_curve(by), k.SURVIVAL_MONTHS, by)

    def survival_by_year(self) -> DataFrame:
        return sv.log_rank(self.survival_input, "survival_days", "died", "year_of_admission")

    def hazards(self, covariates: Sequence[str] = ("year_of_admission",),
                horizon: int | None = None) -> DataFrame:
        """Proportional hazards, optionally with follow-up cut at a horizon."""
        rows = self.survival_input
        if horizon is not None:
            time, event = r.censor_at(F.col("survival_days"), F.col("died"), horizon)
            rows = rows.select(*covariates, time.alias("survival_days"), event.alias("died"))
        return sv.cox_ph(rows, "survival_days", "died", {name: None for name in covariates})

    def follow_up_quantiles(self) -> DataFrame:
        """Quartiles of follow-up in months."""
        months = self.cohort.withColumn("fu_months", F.col("fu_days") / k.DAYS_PER_MONTH)
        return quantiles(months, "fu_months", [0.25, 0.5, 0.75])

    @cached_property
    def master(self) -> DataFrame:
        """One row per person of the base cohort with every covariate."""
        return assemble_master(self.cohort_base, [
            *[t.drop(INDEX) for t in (self.hypertension, self.ckd, self.chd, self.diabetes)],
            self.previous_stroke.select(PERSON, "previous_stroke"),
            self.smoking.select(PERSON, "smoking_status"),
            self.deprivation.select(PERSON, F.col("decile").alias("imd")),
            self.ethnicity.select(PERSON, F.col("category").alias("ethnicity")),
            self.bp_pre.select(PERSON, F.col("systolic").alias("pre_systolic")),
            self.bp_post.select(PERSON, "systolic", "reading_date")])

    def clinical(self, breaks: Sequence[float] = k.FRAILTY_BREAKS) -> DataFrame:
        """Master with frailty band, cleaned body mass index and control target.

        Needs two more sources: ``frailty`` (person_id, efi2) and ``bmi`` (person_id, bmi).
        """
        measured = assemble_master(self.master, [self.t["frailty"], self.t["bmi"]])
        target = (k.TARGET_AGE, k.TARGET_OLD, k.TARGET_YOUNG)
        return p.derive_clinical_labels(
            measured.where("hypertension"), "efi2", breaks, k.FRAILTY_LABELS, "bmi", k.BMI_RANGE,
            "systolic", "age_at_index", target)

    def missingness(self, value: str) -> DataFrame:
        """Does a measure differ between persons with and without a reading?"""
        return st.welch_t(self.clinical(), value, "reading_present", ("missing", "yes"))

    def control_by_drugs(self, cap: int = 3, excluding: Sequence[str] = ("beta_blocker",)) -> DataFrame:
        """Control after admission by number of classes at admission."""
        counts = x.class_counts(self.drugs_kept.where(F.col("time_status") == "admission"),
                                excluding, list(k.DRUG_CLASSES))
        return x.count_by_control(counts, self.clinical(), cap)

    def hypertension_prevalence(self) -> DataFrame:
        counts = prevalence(self.hypertension, F.col("hypertension"))
        return st.binomial_ci(counts, "n_flagged", "n")

    def demographics(self) -> DataFrame:
        people = self.master.where("hypertension").withColumn(
            "ethnicity", recode(F.col("ethnicity"), k.ETHNICITY_COLLAPSE))
        return summary_table(people, ["age_at_index", "mortality_days"],
                             ["admission_service", "gender", "imd", "ethnicity"], na_include=True)

    def pressure_change(self, near_death_days: int | None = None) -> DataFrame:
        """Paired test of systolic before and after, for those on treatment at
        admission; optionally without readings near death."""
        treated = self.drugs_at("admission").where(F.col("n_classes") >= 1)
        both = restrict_to(self.bp_difference, treated)
        if near_death_days is not None:
            flagged = both.join(self.cohort.select(PERSON, "dod"), PERSON)
            near = p.near_death_flag(F.col("post_date"), F.col("dod"), near_death_days)
            both = flagged.where(~near)
        return st.paired_t(both, "pre_systolic", "post_systolic")
