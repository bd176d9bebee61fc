"""Schemas of records and logs."""

from __future__ import annotations

from ..operators.costs import COST, TIER

RECORD = f"""school_name string, homepage_url string, status string, page_scraped string, elapsed_sec double,
curriculum string, tuition_found boolean, tuition_by_grade array<{TIER}>, hidden_costs array<{COST}>,
safety_and_security struct<security_guards:boolean,cctv_monitoring:boolean,nurse_medical_clinic:boolean,
child_safeguarding_policy:boolean,air_quality_pm25_protocol:boolean,visitor_access_control:boolean,
highlights:array<string>,policy_summary:string,policy_url:string>,
confidence double, confidence_reasoning string, tuition_min_thb bigint, tuition_max_thb bigint"""

LOG = "school_name string, step string, action_taken string, url_visited string, decision_reasoning string, confidence double, status string, at timestamp"

SCHOOL = """id bigint, name string, curriculum string, location string, tuitionStart bigint, rating double, reviewCount bigint, distance double,
language string, grades string, image string, badge string, lastUpdated string"""

DETAIL = """id bigint, founded string, students string, accreditation array<string>, website string, about string,
fees array<struct<label:string,amount:string>>, gallery array<string>, facilities array<string>,
reviews array<struct<author:string,avatar:string,rating:double,text:string,time:string,childYear:string>>,
safety struct<securityGuards:string,cctv:string,medicalNurse:string,safeguardingPolicy:string,airQualityPM25:string,visitorControl:string,
emergencyDrill:string,summary:string,highlights:array<string>,policyUrl:string>, lastUpdated string"""

POST = """id bigint, author string, avatar string, role string, schoolTag string, schoolId bigint, category string, title string, content string,
time string, likes bigint, liked boolean,
comments array<struct<id:bigint,author:string,avatar:string,content:string,time:string,likes:bigint,liked:boolean>>, image string"""

COORDINATE = "id bigint, name string, lat double, lng double, tuition string, rating double"
