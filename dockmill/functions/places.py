"""Fixed values of the country rules: names of countries, peoples and languages, in natural order."""

# These have to be these for equal results.
COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Angola", "Argentina", "Armenia", "Azerbaijan", "Bangladesh", "Belarus", "Bhutan", "Bolivia", "Bosnia", "Brazil", "Brunei", "Bulgaria", "Burma", "Burundi", "Cambodia", "Cameroon",
    "Central African Republic", "Chad", "Chile", "China", "Colombia", "Comoros", "Congo", "Croatia", "Cuba", "Czech Republic", "Djibouti", "Dominican Republic", "East Timor", "Ecuador", "Egypt", "El Salvador", "Eritrea",
    "Estonia", "Ethiopia", "Fiji", "France", "Gambia", "Georgia", "Germany", "Ghana", "Greece", "Guatemala", "Guinea", "Guinea-Bissau", "Guyana", "Haiti", "Honduras", "Hungary", "India", "Indonesia", "Iran", "Iraq",
    "Ireland", "Israel", "Italy", "Ivory Coast", "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati", "Korea", "Kosovo", "Kuwait", "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya",
    "Lithuania", "Macedonia", "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali", "Malta", "Mauritania", "Mauritius", "Mexico", "Moldova", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Myanmar", "Namibia",
    "Nauru", "Nepal", "Netherlands", "New Zealand", "Nicaragua", "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan", "Palestine", "Panama", "Papua New Guinea", "Paraguay", "Peru",
    "Philippines", "Poland", "Portugal", "Qatar", "Romania", "Russia", "Rwanda", "Samoa", "Saudi Arabia", "Senegal", "Serbia", "Sierra Leone", "Singapore", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Korea", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden", "Switzerland", "Syria", "Taiwan", "Tajikistan", "Tanzania", "Thailand", "Timor-Leste", "Togo", "Tonga", "Trinidad",
    "Tunisia", "Turkey", "Turkmenistan", "Tuvalu", "Uganda", "Ukraine", "United Arab Emirates", "United Kingdom", "United States", "Uruguay", "Uzbekistan", "Vanuatu", "Venezuela", "Vietnam", "Yemen", "Zambia",
    "Zimbabwe",
]
#: People: country.
PEOPLES = {
    "Afghan": "Afghanistan", "Albanian": "Albania", "Algerian": "Algeria", "Angolan": "Angola", "Argentine": "Argentina", "Armenian": "Armenia", "Azerbaijani": "Azerbaijan", "Bangladeshi": "Bangladesh",
    "Belarusian": "Belarus", "Bhutanese": "Bhutan", "Bolivian": "Bolivia", "Bosnian": "Bosnia", "Brazilian": "Brazil", "Bulgarian": "Bulgaria", "Burmese": "Myanmar", "Burundian": "Burundi", "Cambodian": "Cambodia",
    "Cameroonian": "Cameroon", "Chadian": "Chad", "Chilean": "Chile", "Chinese": "China", "Colombian": "Colombia", "Congolese": "Congo", "Croatian": "Croatia", "Cuban": "Cuba", "Czech": "Czech Republic",
    "Dominican": "Dominican Republic", "Ecuadorian": "Ecuador", "Egyptian": "Egypt", "Eritrean": "Eritrea", "Estonian": "Estonia", "Ethiopian": "Ethiopia", "Fijian": "Fiji", "French": "France", "Georgian": "Georgia",
    "German": "Germany", "Ghanaian": "Ghana", "Greek": "Greece", "Guatemalan": "Guatemala", "Guinean": "Guinea", "Guyanese": "Guyana", "Haitian": "Haiti", "Honduran": "Honduras", "Hungarian": "Hungary",
    "Indian": "India", "Indonesian": "Indonesia", "Iranian": "Iran", "Iraqi": "Iraq", "Irish": "Ireland", "Israeli": "Israel", "Italian": "Italy", "Jamaican": "Jamaica", "Japanese": "Japan", "Jordanian": "Jordan",
    "Kazakh": "Kazakhstan", "Kenyan": "Kenya", "Korean": "Korea", "Kosovar": "Kosovo", "Kuwaiti": "Kuwait", "Kyrgyz": "Kyrgyzstan", "Laotian": "Laos", "Latvian": "Latvia", "Lebanese": "Lebanon", "Liberian": "Liberia",
    "Libyan": "Libya", "Lithuanian": "Lithuania", "Macedonian": "Macedonia", "Malagasy": "Madagascar", "Malawian": "Malawi", "Malaysian": "Malaysia", "Maldivian": "Maldives", "Malian": "Mali", "Maltese": "Malta",
    "Mauritian": "Mauritius", "Mexican": "Mexico", "Moldovan": "Moldova", "Mongolian": "Mongolia", "Montenegrin": "Montenegro", "Moroccan": "Morocco", "Mozambican": "Mozambique", "Namibian": "Namibia",
    "Nauruan": "Nauru", "Nepalese": "Nepal", "Nepali": "Nepal", "Dutch": "Netherlands", "New Zealander": "New Zealand", "Nicaraguan": "Nicaragua", "Nigerian": "Nigeria", "Norwegian": "Norway", "Omani": "Oman",
    "Pakistani": "Pakistan", "Palestinian": "Palestine", "Panamanian": "Panama", "Papua New Guinean": "Papua New Guinea", "Paraguayan": "Paraguay", "Peruvian": "Peru", "Filipino": "Philippines",
    "Philippine": "Philippines", "Polish": "Poland", "Portuguese": "Portugal", "Qatari": "Qatar", "Romanian": "Romania", "Russian": "Russia", "Rwandan": "Rwanda", "Samoan": "Samoa", "Saudi": "Saudi Arabia",
    "Senegalese": "Senegal", "Serbian": "Serbia", "Sierra Leonean": "Sierra Leone", "Singaporean": "Singapore", "Slovak": "Slovakia", "Slovenian": "Slovenia", "Somali": "Somalia", "South African": "South Africa",
    "South Sudanese": "South Sudan", "Spanish": "Spain", "Sri Lankan": "Sri Lanka", "Sudanese": "Sudan", "Surinamese": "Suriname", "Swedish": "Sweden", "Swiss": "Switzerland", "Syrian": "Syria", "Taiwanese": "Taiwan",
    "Tajik": "Tajikistan", "Tanzanian": "Tanzania", "Thai": "Thailand", "Timorese": "Timor-Leste", "Togolese": "Togo", "Tongan": "Tonga", "Trinidadian": "Trinidad", "Tunisian": "Tunisia", "Turkish": "Turkey",
    "Turkmen": "Turkmenistan", "Tuvaluan": "Tuvalu", "Ugandan": "Uganda", "Ukrainian": "Ukraine", "Emirati": "United Arab Emirates", "British": "United Kingdom", "American": "United States", "Uruguayan": "Uruguay",
    "Uzbek": "Uzbekistan", "Venezuelan": "Venezuela", "Vietnamese": "Vietnam", "Yemeni": "Yemen", "Zambian": "Zambia", "Zimbabwean": "Zimbabwe",
}
#: Language of an interpreter: country; the first that is named counts.
LANGUAGES = {
    "Mandarin": "China", "Cantonese": "China", "Putonghua": "China", "Arabic": "Egypt", "Dari": "Afghanistan", "Pashto": "Afghanistan", "Hazaragi": "Afghanistan", "Farsi": "Iran", "Persian": "Iran",
    "Vietnamese": "Vietnam", "Tamil": "Sri Lanka", "Sinhalese": "Sri Lanka", "Sinhala": "Sri Lanka", "Hindi": "India", "Punjabi": "India", "Bengali": "Bangladesh", "Urdu": "Pakistan", "Burmese": "Myanmar",
    "Karen": "Myanmar", "Nepali": "Nepal", "Khmer": "Cambodia", "Thai": "Thailand", "Indonesian": "Indonesia", "Bahasa Indonesia": "Indonesia", "Tagalog": "Philippines", "Filipino": "Philippines", "Tigrinya": "Eritrea",
    "Tigre": "Eritrea", "Amharic": "Ethiopia", "Oromo": "Ethiopia", "Somali": "Somalia", "Swahili": "Tanzania", "Rohingya": "Myanmar", "Kurdish": "Iraq", "Kurmanji": "Iraq", "Sorani": "Iraq", "Hazara": "Afghanistan",
    "Uzbek": "Uzbekistan", "Turkmen": "Turkmenistan", "Georgian": "Georgia", "Ukrainian": "Ukraine", "Russian": "Russia", "Bahasa Malaysia": "Malaysia", "Malay": "Malaysia",
}
# End of fixed values.
