"""Codes and names of countries and states. All of these are fixed values."""

COUNTRIES = {
    "US": "United States", "CA": "Canada", "GB": "United Kingdom", "AU": "Australia", "NZ": "New Zealand",
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "HR": "Croatia", "CY": "Cyprus", "CZ": "Czech Republic", "DK": "Denmark", "EE": "Estonia", "FI": "Finland",
    "FR": "France", "DE": "Germany", "GR": "Greece", "HU": "Hungary", "IE": "Ireland", "IT": "Italy", "LV": "Latvia", "LT": "Lithuania", "LU": "Luxembourg",
    "MT": "Malta", "NL": "Netherlands", "NO": "Norway", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SK": "Slovakia", "SI": "Slovenia", "ES": "Spain",
    "SE": "Sweden", "CH": "Switzerland", "AR": "Argentina", "BR": "Brazil", "CL": "Chile", "CO": "Colombia", "MX": "Mexico", "PE": "Peru", "VE": "Venezuela",
    "CN": "China", "IN": "India", "ID": "Indonesia", "JP": "Japan", "MY": "Malaysia", "PH": "Philippines", "SG": "Singapore", "KR": "South Korea",
    "TH": "Thailand", "VN": "Vietnam", "AE": "United Arab Emirates", "BH": "Bahrain", "IL": "Israel", "JO": "Jordan", "KW": "Kuwait", "OM": "Oman",
    "QA": "Qatar", "SA": "Saudi Arabia", "TR": "Turkey", "EG": "Egypt", "KE": "Kenya", "MA": "Morocco", "NG": "Nigeria", "ZA": "South Africa",
}
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri",
    "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: Codes that may follow a comma instead of a US state.
COMMA_COUNTRIES = ("AE", "AU", "BR", "CA", "CN", "DE", "FR", "GB", "IN", "IT", "JP", "MX", "MY", "NL", "NO", "PT", "SG", "TR", "US")
SPECIAL_PLACES = ("Global Recruiting", "Gulf of Mexico", "Noble Interceptor")
